import random

import pyarrow as pa
from pyspark.sql import functions as F

from tessellary.operators import code_graph, wordsets


def _sets(n, seed, words=60):
    rng = random.Random(seed)
    return [(i, sorted({f"w{int(rng.random() ** 2 * words)}" for _ in range(rng.randint(1, 30))})) for i in range(n)]


def _want(sets, least):
    return {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for i, a in sets for j, b in sets if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) > least}


def test_a_cell_counts_columns_and_lists_exactly(monkeypatch):
    for name, value in (("SUB", 16), ("DENSE", 8), ("CODED", 20), ("SPREAD", 64)):
        monkeypatch.setattr(wordsets, name, value)
    sets = _sets(90, 1)
    code = {f"w{i}": i for i in range(20)}

    def batch(rows):
        columns = {"id": [i for i, _ in rows], "members": [1] * len(rows)}
        lists = {"codes": pa.array([[code[w] for w in s if w in code] for _, s in rows], pa.list_(pa.int16())), "rares": pa.array([[hash(w) for w in s if w not in code] for _, s in rows], pa.list_(pa.int64()))}
        return pa.RecordBatch.from_pydict({**columns, "n": pa.array([len(s) for _, s in rows], pa.int32()), **lists})

    for sides in ([[batch(sets[:50])], [batch(sets[50:])]], [[batch(sets)], []]):
        got = {}
        for x, a, y, b, jaccard in wordsets._alike(sides, 0.3):
            for p, q, v in zip(a.tolist(), b.tolist(), jaccard.tolist(), strict=True):
                key = tuple(sorted((x.ids[p].as_py(), y.ids[q].as_py())))
                assert key not in got
                got[key] = v
        want = _want(sets, 0.3)
        assert got == (want if not sides[1] else {k: v for k, v in want.items() if k[0] < 50 <= k[1]})


def test_blocks_meet_once_and_links_count_members(spark):
    sets = [*_sets(150, 2), (900, ["alone"])]
    rows = wordsets.coded(spark.createDataFrame(sets, "id long, s array<string>")).withColumn("members", F.col("id") % 3 + 1)
    for least in (0.3, 0.8):
        want = _want(sets, least)
        got = [(min(r.x, r.y), max(r.x, r.y), r.jaccard) for r in wordsets.pairs(rows, least, block=1500).collect()]
        assert len(got) == len(want) and {(a, b): j for a, b, j in got} == want
        near = {}
        for a, b in want:
            near[a], near[b] = near.get(a, 0) + b % 3 + 1, near.get(b, 0) + a % 3 + 1
        assert {r.id: r.near for r in wordsets.links(rows, least, block=1500).collect()} == near
    assert wordsets.pairs(rows.where("false"), 0.3).collect() == []


def test_pairs_are_not_shuffled_to_be_compared(spark):
    items = spark.createDataFrame([(i, " ".join(s)) for i, s in _sets(40, 3)], "id long, t string")
    plan = code_graph.similar_pairs(items, "id", "t", 0.3)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("broadcast" in line for line in joins) and "Aggregate" not in plan


def test_a_set_is_written_once_however_many_blocks_it_meets(spark, monkeypatch):
    sets = [*_sets(120, 4), (900, ["alone"])]
    rows = wordsets.coded(spark.createDataFrame([*sets, sets[0]], "id long, s array<string>")).withColumn("members", F.lit(1).cast("long"))
    cut = []
    monkeypatch.setattr(wordsets, "_cut", lambda df, f=wordsets._cut: (cut.append(f(df)), cut[-1])[1])
    found = wordsets.pairs(rows, 0.3, block=1500)
    assert "Repartition" not in found._jdf.queryExecution().optimizedPlan().toString() and len(cut) == 1
    blocks = {r.block: pa.ipc.open_stream(r.sets).read_all()["id"].to_pylist() for r in cut[0].collect()}
    assert len(blocks) > 4 and sorted(i for ids in blocks.values() for i in ids) == [i for i, _ in sets]
    assert {(min(r.x, r.y), max(r.x, r.y)): r.jaccard for r in found.collect()} == _want(sets, 0.3)


def test_classes_shuffle_no_sets_beside_few_copies(spark, monkeypatch):
    rows = [(i, f"w{i % 7} w{i % 5} w{i}" if i % 3 else "b a") for i in range(40)]
    items = spark.createDataFrame(rows, "id long, t string")
    for most in (100, 0):
        monkeypatch.setattr(code_graph, "BROADCAST_ROWS", most)
        distinct = code_graph._classes(code_graph._word_sets(items, "id", "t"))[1]
        assert ("broadcast" in distinct._jdf.queryExecution().optimizedPlan().toString()) == bool(most)
        assert sorted((r.id, r.members) for r in distinct.collect()) == [(0, 14), *((i, 1) for i in range(40) if i % 3)]


def test_consolidation_shuffles_no_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(wordsets, "pairs", lambda sets, least, f=wordsets.pairs: (seen.append(sets), f(sets, least))[1])
    long = "unusual" * 50
    items = spark.createDataFrame([(1, "s", f"{long} a b", 3), (2, "s", f"A b {long}", 2), (3, "t", f"{long} a b", 1)], "id long, k string, t string, n int")
    assert {r.id: r.kept for r in code_graph.consolidated(items, "id", "k", "t", -F.col("n"), 0.8).collect()} == {2: 1}
    assert len(seen) == 1 and {"codes", "rares"} <= set(seen[0].columns) and not {"text", "t", "s"} & set(seen[0].columns)


def test_pairs_of_items_are_widened_by_copies_only(spark):
    rows = [(i, "one two three") for i in range(5)] + [(10, "one two three four"), (11, "Four three two one"), (12, "five"), (13, None)]
    items = spark.createDataFrame(rows, "id long, t string")
    sets = {i: set(t.lower().split()) for i, t in rows if t}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) > 3 * len(sets[a] | sets[b])}
    found = code_graph.similar_items(items, "id", "t", 0.3)
    got = [(r.a, r.b, r.jaccard) for r in found.collect()]
    assert len(got) == len(want) and {(a, b): j for a, b, j in got} == want
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()  # sets are compared before the pairs are written


def test_sets_of_other_kinds_share_no_cell(spark, monkeypatch):
    sets = _sets(160, 5)
    items = spark.createDataFrame([(i, "pqrs"[i % 4] if i % 5 else None, " ".join(s), len(s)) for i, s in sets], "id long, k string, t string, n int")
    met = []
    monkeypatch.setattr(wordsets, "pairs", lambda sets, least, f=wordsets.pairs: (met.append(f(sets, least, block=900)), met[-1])[1])
    got = {r.id: r.kept for r in code_graph.consolidated(items, "id", "k", "t", -F.col("n"), 0.4).collect()}
    kind = {i: "pqrs"[i % 4] if i % 5 else None for i, _ in sets}
    want, kept = {}, []
    for i, s in sorted(sets, key=lambda r: (-len(r[1]), r[0])):
        hit = next((j for j, t in kept if kind[j] == kind[i] and len(set(s) & set(t)) > 0.4 * len(set(s) | set(t))), None)
        if hit is None:
            kept.append((i, s))
        else:
            want[i] = hit
    assert got == want and len(want) > 3
    # of the pairs over 0.4 those of one kind were found, and not all others
    over = _want([(i, s) for i, s in sets], 0.4)
    assert sum(kind[a] == kind[b] for a, b in over) * 2 <= len(over) and met[0].count() < len(over) * 0.6
