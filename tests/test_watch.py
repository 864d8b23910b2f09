"""Watchers, reminders and replayed syncs, in one batch and in many."""

import datetime as dt

import pytest

from tessellary.streaming import events, watch

START = dt.datetime(2024, 1, 1)
SCHEMA = "key string, at timestamp, number long, head string, branch string, outdated boolean"
#: key, hour, number, head, branch, outdated
ROWS = [
    ("a", 0, 1, "h1", "main", True), ("a", 1, 2, "h1", "main", None), ("b", 1, 3, "h9", "wip", True), ("a", 5, 4, "h2", "main", True), ("a", 5, 5, "h2", "dev", None),
    ("b", 6, 6, "h8", "main", False), ("a", 7, 7, "h3", "wip", False), ("a", 8, 8, "h4", None, None), ("b", 9, 9, "h8", "main", True), (None, 9, 10, "x", "x", True),
    ("a", 12, 11, "h4", None, None), ("b", 16, 12, None, "main", None),
]


def stream(spark, folder, cuts):
    """ROWS as files, cut before some numbers, read one file a batch."""
    bounds = [0, *cuts, 99]
    for n, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        rows = [(k, START + dt.timedelta(hours=h), i, head, branch, out) for k, h, i, head, branch, out in ROWS if low < i <= high]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}/{n:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{folder}")


@pytest.mark.parametrize("cuts", [[], [3, 6, 9]])
def test_changes(spark, tmp_path, cuts):
    with watch.timed_state(spark):
        out = events.run_to_table(watch.changes(stream(spark, tmp_path, cuts), "1 day", ("wip",)))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        ("a", 4, "head-change", "h1", "h2"), ("a", 5, "branch-change", "main", "dev"), ("a", 8, "head-change", "h2", "h4"), ("a", 8, "branch-change", "dev", None),
        ("b", 12, "head-change", "h8", None),
    ], key=str)


@pytest.mark.parametrize("cuts", [[], [3, 6, 9]])
def test_reminders(spark, tmp_path, cuts):
    with watch.timed_state(spark):
        out = events.run_to_table(watch.reminders(stream(spark, tmp_path, cuts), "0 seconds", 2 * 3600))
    hour = lambda t: int((t - START).total_seconds() // 3600)
    # a is outdated from 0 to 7, b from 1 to 6 and from 9 on; time goes to 16
    assert sorted((r.key, hour(r.since), hour(r["at"])) for r in out.collect()) == [
        ("a", 0, 2), ("a", 0, 4), ("a", 0, 6), ("b", 1, 3), ("b", 1, 5), ("b", 9, 11), ("b", 9, 13), ("b", 9, 15)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    sync = watch.Sync(spark, ["k"], ["at"], kept=2, base=f"file://{tmp_path}/sync")
    assert sync.table() is None
    frame = lambda *rows: spark.createDataFrame(rows, "k string, at int, v string")
    sync(frame(("a", 1, "x"), ("b", 1, "y"), ("a", 0, "old")), 0)
    sync(frame(("a", 2, "z"), (None, 1, "n")), 1)
    first = sorted(map(str, sync.table().collect()))
    assert first == sorted(map(str, frame(("a", 2, "z"), ("b", 1, "y"), (None, 1, "n")).collect()))
    sync(frame(("a", 9, "other")), 0)
    sync(frame(("a", 9, "other")), 1)
    assert sorted(map(str, sync.table().collect())) == first
    for number in (2, 2, 2):
        with pytest.raises(Exception, match="k"):
            sync(spark.createDataFrame([(1,)], "other int"), number)
    assert [n for n, _ in sync.errors] == [2, 2]
    sync(frame(), 2)
    assert sync.errors == [] and sorted(map(str, sync.table().collect())) == first
