"""Pairs of alike nodes: all of brute force's, each once, and none that frequent values alone would join."""

import random

from tessellary.operators import alike, knowledge, relations

NODE = "id long, name string, tags array<string>, page string, file string"


def test_similar_nodes_of_all_pairs(spark):
    rng = random.Random(11)
    some = lambda *x: rng.choice(x)
    nodes = [(i, some("Alpha", "alphabet", "", None, "Beta"), some([], ["A", "b"], ["a"], ["b", "c", "D"], ["x", None], ["hot", "a"]), some("p", "q", None), some("f", "g", None)) for i in range(80)]

    def score(a, b):
        x, y = ({t and t.lower() for t in n[2]} for n in (a, b))
        u, v = ((n[1].lower() if n[1] is not None else None) for n in (a, b))
        equal = lambda i: a[i] is not None and a[i] == b[i]
        inside = u is not None and v is not None and (u in v or v in u)
        return round((len(x & y) / len(x | y) if x | y else 0.0) * 0.4 + equal(3) * 0.3 + equal(4) * 0.2 + inside * 0.1, 6)

    df = spark.createDataFrame(nodes, NODE)
    for least in (0.15, 0.35, 0.5, 0.8):
        want = sorted((a[0], b[0], s) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (s := score(a, b)) >= least)
        assert sorted(map(tuple, knowledge.similar_nodes(df, least).collect())) == want


def test_frequent_tags_and_files_alone_meet_nobody(spark):
    # 0.5 needs the same tags where no page is shared: a third of a million pairs shared a tag and a file before
    nodes = spark.createDataFrame([(i, f"n{i:04d}", ["hot", f"t{i}"], None, None) for i in range(800)], NODE)
    assert alike.pairs(nodes, None, 0.5, strict=False).count() == 0


def test_likeness_shuffles_no_pairs(spark):
    nodes = spark.createDataFrame([(i, "concept", "n", ["a"], "p", "f") for i in range(3)], "id long, type string, name string, tags array<string>, page string, file string")
    found = relations.inferred_by_likeness(nodes, spark.createDataFrame([(1, 0)], "source long, target long"))
    assert sorted((r.source, r.target) for r in found.collect()) == [(0, 2), (1, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [least(" not in plan and "Aggregate [a_id" not in plan  # pairs were made distinct and grouped before


def test_nodes_of_a_profile_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(alike, "CHUNK", 4)
    kinds = [("class", "p", "f", ["a", "b"]), ("class", "p", None, ["b", "c"]), ("interface", "q", "f", ["b", "a"]), ("interface", "p", "f", [])]
    nodes = [(i, *kinds[i % 4][:1], ("One", "one two", None)[i % 3], kinds[i % 4][3], *kinds[i % 4][1:3]) for i in range(90)]
    df = spark.createDataFrame(nodes, "id long, type string, name string, tags array<string>, page string, file string")
    assert alike._profiles(df).count() < 45  # a row for some nodes of a profile, which are compared in their place

    def likeness(a, b):
        x, y = set(a[3]), set(b[3])
        u, v = ((n[2].lower() if n[2] is not None else None) for n in (a, b))
        equal = lambda i: a[i] is not None and a[i] == b[i]
        inside = u is not None and v is not None and (u in v or v in u)
        return (len(x & y) / len(x | y) if x | y else 0.0) * 0.4 + equal(4) * 0.3 + equal(5) * 0.2 + inside * 0.1

    want = {}
    for a in nodes:
        for b in nodes:
            rule = {("class", "interface"): ("implements", 0.8), ("class", "class"): ("extends", 0.7)}.get((a[1], b[1]))
            if rule and (a[0] < b[0] if a[1] == b[1] else True) and likeness(a, b) > 0.3:
                want[a[0], b[0]] = (rule[0], round(likeness(a, b) * rule[1], 6))
    found = relations.inferred_by_likeness(df, spark.createDataFrame([], "source long, target long"), digits=6)
    got = found.collect()
    assert len(got) == len(want) > 1000 and {(r.source, r.target): (r.type, r.weight) for r in got} == want
