"""What is saved comes back: logs by month, versions by page, caches by key."""

import datetime as dt

from pyspark.sql import functions as F

from tessellary.sources import stored


def test_logs_open_only_their_months(spark, tmp_path):
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1 + i % 5, 1 + i % 28), f"e{i}", "x") for i in range(100)], "id int, at timestamp, what string, cut string")
    schema = rows.drop("cut").schema
    store = stored.log_store(spark, f"file://{tmp_path}/log", schema, "id", "at")
    assert store.load().collect() == []
    store.save(rows)
    store.save(rows.where("id = 7").withColumn("what", F.lit("again")))
    start, end = dt.datetime(2024, 2, 10), dt.datetime(2024, 3, 31)
    got = stored.logged(store, "at", start, end)
    assert [(r.id, r.what) for r in got.collect()] == [
        (r.id, "again" if r.id == 7 else r.what) for r in sorted(rows.collect(), key=lambda r: (-r["at"].timestamp(), r.id)) if start <= r["at"] <= end
    ]
    opened = {f.split("cut=")[1].split("/")[0] for f in store.files().where("cut >= '2024-02' and cut <= '2024-03'").inputFiles()}
    assert {"2024-02", "2024-03"} <= opened
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cut" in plan.split("PartitionFilters")[1][:80]
    assert stored.logged(store, "at").count() == 100


def test_versions_by_page(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "q"), (None, 1, "n")], "page string, version int, text string")
    store = stored.version_store(spark, f"file://{tmp_path}/v", rows.schema, "page", "version", cuts=4)
    store.save(rows)
    store.save(spark.createDataFrame([("a", 2, "new")], rows.schema))
    listed = lambda df: [(r.page, r.version, r.text) for r in df.orderBy("page", F.desc("version")).collect()]
    assert listed(stored.versions_of(store, ["a"])) == [("a", 3, "z"), ("a", 2, "new"), ("a", 1, "x")]
    assert listed(stored.versions_of(store, ["a", "b", "c"], newest=1)) == [("a", 3, "z"), ("b", 1, "q")]
    assert listed(stored.versions_of(store, rows.select("page"), newest=1, skip=1)) == [("a", 2, "new")]
    assert store.load().count() == 5
    store.save(rows.where("false"))
    assert store.load().count() == 5


def test_caches_by_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [])], "id long, v array<double>")
    store = stored.cache_store(spark, f"file://{tmp_path}/c", rows.schema, "id")
    store.save(rows)
    assert sorted(map(str, store.load().collect())) == sorted(map(str, rows.collect()))
    now = spark.createDataFrame([(1, [1.0, 2.5]), (2, None), (3, []), (4, [1.0])], rows.schema)
    assert sorted(r.id for r in stored.unchanged(store, now, "id", "v").collect()) == [2, 3]
