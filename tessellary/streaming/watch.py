"""Watchers and reminders with keyed state and timers, and syncs that may be replayed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import shared_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """State stores that can hold timers, for queries that are started meanwhile."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one batch by time, then number."""
    return pd.concat(list(rows)).sort_values(["at", "number"], kind="stable")


class _Watcher(StatefulProcessor):
    """Remembers a key's head and branch; the first observation sets them, ignored branches are passed over."""

    def __init__(self, ignored: tuple[str, ...]) -> None:
        self.ignored = ignored

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "head string, branch string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        held = self.last.get() if self.last.exists() else None
        ordered, found = _in_order(rows), []
        for number, head, branch in zip(*(ordered[c] for c in ("number", "head", "branch")), strict=True):
            if branch in self.ignored:
                continue
            if held is not None:
                found += [(key[0], int(number), kind, was, now) for kind, was, now in (("head-change", held[0], head), ("branch-change", held[1], branch)) if was != now]
            held = (head, branch)
        if held is not None:
            self.last.update(tuple(held))
        yield pd.DataFrame(found, columns=["key", "number", "type", "before", "after"])

    def close(self) -> None:
        pass


def changes(stream: DataFrame, late: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(key, number, type, before, after) of a stream of observations (key: string, at, number: long, head, branch: strings).

    A head-change or branch-change for each observation that differs from the key's last one. Observations on ``ignored`` branches change nothing
    and are forgotten, null heads and branches are values, rows later than ``late`` are left out.
    """
    schema = "key string, number bigint, type string, before string, after string"
    given = stream.where("key is not null").select("key", "at", "number", "head", "branch").withWatermark("at", late)
    return given.groupBy("key").transformWithStateInPandas(_Watcher(ignored), schema, "Append", "EventTime")


class _Reminder(StatefulProcessor):
    """Since when a key is outdated and when it is next reminded of, in milliseconds; a timer wakes it when no row does."""

    def __init__(self, interval: int) -> None:
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("outdated", "since bigint, next bigint")

    def due(self, since: int, following: int, now: int) -> tuple[list[tuple[int, int]], int]:
        """Reminders up to ``now``, as (since, at), and the time of the next."""
        times = range(following, now + 1, self.interval)
        return [(since, x) for x in times], following + len(times) * self.interval

    def rows(self, key: str, found: list[tuple[int, int]]) -> pd.DataFrame:
        stamps = [pd.Series([x[i] for x in found], dtype="int64").astype("datetime64[ms]") for i in (0, 1)]
        return pd.DataFrame({"key": pd.Series([key] * len(found), dtype=object), "since": stamps[0], "at": stamps[1]})

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        held = tuple(self.state.get()) if self.state.exists() else None
        before, found = held, []
        ordered = _in_order(rows)
        for at, outdated in zip(ordered["at"], ordered["outdated"], strict=True):
            now = int(at.timestamp() * 1000)
            if held is not None:
                more, following = self.due(*held, now)
                found += more
                held = (held[0], following)
            if outdated is not None and bool(outdated):
                held = held or (now, now + self.interval)
            elif outdated is not None:
                held = None
        if before is not None and before != held:
            self.handle.deleteTimer(before[1])
        if held is None:
            self.state.clear()
        elif before != held:
            self.state.update(held)
            self.handle.registerTimer(held[1])
        yield self.rows(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        found = []
        if self.state.exists():
            since, following = self.state.get()
            found, following = self.due(since, following, timerValues.getCurrentWatermarkInMs())
            self.state.update((since, following))
            self.handle.registerTimer(following)
        yield self.rows(key[0], found)

    def close(self) -> None:
        pass


def reminders(stream: DataFrame, late: str, every_seconds: int) -> DataFrame:
    """(key, since, at): while a key of the stream (key: string, at, number: long, outdated: boolean) is outdated, a reminder each interval.

    A true row makes a key outdated from its time on unless it is already, a false row ends that, a null row leaves it. Reminders are due up to the
    watermark, rows' own times included, and are the same however the stream is cut into batches.
    """
    given = stream.where("key is not null").select("key", "at", "number", "outdated").withWatermark("at", late)
    return given.groupBy("key").transformWithStateInPandas(_Reminder(every_seconds * 1000), "key string, since timestamp, at timestamp", "Append", "EventTime")


class Sync:
    """Applies batches of a stream to a table of current values, once each, and keeps the last errors.

    ``table`` is a folder of versions: every batch writes a whole new one under its own number, from that of the batch before, and then says that it is
    complete. A batch that comes again finds its version complete and does nothing, one that broke off is written anew, so a replay changes
    nothing. A batch that fails is noted among the last ``kept`` errors and raised; a batch that ends well clears them, as a sync does.
    """

    def __init__(self, spark: SparkSession, keys: list[str], order: list[str], kept: int = 10, base: str | None = None) -> None:
        self.spark, self.keys, self.order, self.kept = spark, keys, order, kept
        self.base = base or f"{shared_dir(spark)}/sync-{uuid.uuid4().hex}"
        self.errors: list[tuple[int, str]] = []

    def _done(self) -> list[int]:
        """Numbers of complete batches."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.base}/batch=*/_SUCCESS")
        found = pattern.getFileSystem(conf).globStatus(pattern) or []
        return sorted(int(x.getPath().getParent().getName().removeprefix("batch=")) for x in found)

    def table(self) -> DataFrame | None:
        """The newest version; None before the first batch."""
        done = self._done()
        return self.spark.read.parquet(f"{self.base}/batch={done[-1]}") if done else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        done = self._done()
        if number in done:
            return
        try:
            before = [n for n in done if n < number]
            rows = batch.withColumn("__new", F.lit(1))
            if before:
                old = self.spark.read.parquet(f"{self.base}/batch={before[-1]}")
                rows = rows.unionByName(old.withColumn("__new", F.lit(0)))
            latest = Window.partitionBy(*self.keys).orderBy(F.desc("__new"), *(F.col(c).desc_nulls_last() for c in self.order))
            kept = rows.withColumn("__r", F.row_number().over(latest)).where("__r = 1").drop("__r", "__new")
            kept.write.mode("overwrite").parquet(f"{self.base}/batch={number}")
        except Exception as error:
            self.errors = [*self.errors, (number, str(error).split("\n")[0])][-self.kept :]
            raise
        self.errors = []


def synced(stream: DataFrame, sync: Callable[[DataFrame, int], None]) -> None:
    """Run all that is there through ``sync``, batch by batch; a query's own checkpoint lets only one run at a time."""
    where = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}/state"
    stream.writeStream.foreachBatch(sync).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
