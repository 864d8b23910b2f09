import numpy as np

from tessellary.operators import best, relations, search


def _copies(seed, many):
    x = np.random.default_rng(seed).standard_normal((many, 6)).astype(np.float32)
    return {i: x[i % many] for i in range(many * 5)}


def _want(rows, ids, k, least):
    u = {i: v.astype(float) / np.linalg.norm(v.astype(float)) for i, v in rows.items()}
    return {i: sorted((-round(float(u[i] @ u[j]), 9), j) for j in rows if j != i and u[i] @ u[j] > least)[:k] for i in ids}


def test_scores_of_equal_rows_are_equal_wherever_they_stand():
    x = np.repeat(np.random.default_rng(1).standard_normal((1, 64)), 1500, axis=0)
    assert len(np.unique(best.products(best.unit(x[:1024]), best.unit(x[:333])))) == 1


def test_a_task_holds_a_bounded_number_of_scores(monkeypatch):
    met = []
    monkeypatch.setattr(best.Best, "meet", lambda self, low, score, others, f=best.Best.meet: (met.append(score.shape), f(self, low, score, others))[1])
    held = best.Best(3000, 2)
    x = best.unit(np.random.default_rng(2).standard_normal((3000, 4)))
    for low in range(0, 3000, best.SIDE):
        held.meet(low, best.products(x[low : low + best.SIDE], x[:500]), np.arange(500))
    assert max(a * b for a, b in met) <= best.SIDE**2 and np.array_equal(held.other[:, 0][:500], np.arange(500))


def test_most_alike_of_copies(spark):
    rows = _copies(3, 40)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "id long, v array<float>").repartition(3)
    for block in (None, 30):
        got = {}
        for r in relations.most_alike(df, 6, 0.2, block).collect():
            got.setdefault(r.id, []).append((-round(r.score, 9), r.other))
        assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in _want(rows, rows, 6, 0.2).items() if v}


def test_vectors_are_copied_for_few_blocks(spark):
    df = spark.range(20_000).selectExpr("id", "array(cast(id % 7 as float), 1f, cast(id % 11 as float)) as v")
    dealt = relations.most_alike(df, 1, 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert dealt.count("Join ") == 1 and "broadcast" in dealt and "collect_list" not in dealt and f"RepartitionByExpression" in dealt


def test_nearest_of_copies(spark):
    rows = _copies(4, 30)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in search.nearest(df, df.where("vec_id % 10 = 0"), 6, 0.2, block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 9), r.id))
    assert got == {i: v for i, v in _want(rows, [i for i in rows if i % 10 == 0], 6, 0.2).items() if v}


def test_queries_are_shared_in_blocks_of_bounded_bytes(spark, monkeypatch):
    shared = []
    sc = type(spark.sparkContext)
    monkeypatch.setattr(sc, "broadcast", lambda self, value, f=sc.broadcast: (shared.append(value), f(self, value))[1])
    rows = _copies(5, 20)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<float>").repartition(2)
    monkeypatch.setattr(search, "SHARED", 8 * 6 * 4, raising=False)
    got = {}
    for r in search.nearest(df, df.where("vec_id % 10 = 0"), 6, 0.2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 9), r.id))
    assert got == {i: v for i, v in _want(rows, [i for i in rows if i % 10 == 0], 6, 0.2).items() if v}
    assert max(q.nbytes for _, q in shared) <= search.SHARED and sum(len(ids) for ids, _ in shared) == 10
