"""Cycles as paths and depth-first walks against recursive versions."""

import random

from tessellary.operators import graph


def cycles(edges, longest):
    out = {}
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def walk(path):
        for n in after.get(path[-1], ()):
            if n == path[0] and len(path) > 1:
                out[(*path, n)] = len(path)
            elif n > path[0] and n not in path and len(path) < longest:
                walk([*path, n])

    for start in after:
        walk([start])
    return out


def test_cycles_are_paths_in_one_rotation(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 11), rng.randint(0, 11)) for _ in range(26)] + [(20, 21), (21, 22), (22, 20), (30, 31), (40, 40), (None, 3), (3, None), (22, 20)]
    df = spark.createDataFrame(edges, "src int, dst int")
    clean = {(a, b) for a, b in edges if a is not None and b is not None and a != b}
    for longest in (2, 4):
        got = graph.cycle_paths(df, longest).collect()
        assert {tuple(r.path): r.length for r in got if r.path} == cycles(clean, longest)
        assert len([r for r in got if r.path]) == len(cycles(clean, longest))
    three = [r for r in graph.cycle_paths(df, 2).collect() if r.component == 22]
    assert [(r.path, r.more) for r in three] == [(None, True)]
    assert [(r.path, r.more) for r in graph.cycle_paths(df, 9).collect() if r.component == 22] == [([20, 21, 22, 20], False)]
    assert (40, [40, 40]) in [(r.component, r.path) for r in graph.cycle_paths(df, 2, loops=True).collect()]


def test_no_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert graph.cycle_paths(df, 5).collect() == []
    assert graph.cycle_paths(df.where("false"), 5).collect() == []
    pair = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert [r.path for r in graph.cycle_paths(pair, 5).collect()] == [["a", "b", "a"]]


def walk_by_hand(edges, entry):
    out, seen = [], set()

    def visit(node, depth, parent):
        seen.add(node)
        out.append((entry, node, len(out), depth, parent))
        for _, n in sorted((r, b) for a, b, r in edges if a == node):
            if n not in seen:
                visit(n, depth + 1, node)

    visit(entry, 0, None)
    return out


def test_walks_go_depth_first(spark):
    rng = random.Random(9)
    for size, n in ((9, 20), (14, 30), (5, 12)):
        edges = list({(a, b): (a, b, rng.randint(0, 3)) for a, b in ((rng.randrange(size), rng.randrange(size)) for _ in range(n))}.values())
        entries = [0, 1, 99]
        got = graph.depth_first(spark.createDataFrame(edges, "src long, dst long, rank int"), spark.createDataFrame([(e,) for e in [*entries, None, 1]], "id long"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted((x for e in entries for x in walk_by_hand(edges, e)), key=str)


def test_flow_steps_name_what_comes_next(spark):
    edges = spark.createDataFrame([("main", "load", 0), ("main", "save", 1), ("load", "save", 0), ("save", "main", 0), ("main", "elsewhere", 2)], "src string, dst string, rank int")
    nodes = spark.createDataFrame([("main", ["run", "stop"]), ("load", None), ("save", [])], "id string, inner array<string>")
    got = graph.flow_steps(edges, spark.createDataFrame([("main",), ("gone",)], "id string"), nodes).orderBy("place").collect()
    assert [(r.id, r.next, r.is_exit) for r in got] == [("main", ["run", "stop", "load"], False), ("load", ["save"], False), ("save", [], True)]
