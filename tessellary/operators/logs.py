"""Logs, history, memory and their retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of sorted rows; a limit of 0 means all that follow the offset."""
    out = rows.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out


def counts_with_zeros(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, n) for each of ``values``, 0 for those without rows."""
    dim = rows.sparkSession.createDataFrame([(v,) for v in values], f"`{key}` string")
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def islands(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows with island, the number of the run of equal values they belong to within their key."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.coalesce((~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"), F.lit(0))
    first = F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(new)
    return rows.withColumn("__new", first).withColumn("island", F.sum("__new").over(w).cast("int")).drop("__new")


def sessions(rows: DataFrame, by: str, at: str, gap_seconds: int) -> DataFrame:
    """(by, start, end, n): runs of rows less than ``gap_seconds`` apart, as a session window makes them."""
    w = F.session_window(at, f"{gap_seconds} seconds")
    found = rows.groupBy(by, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"))
    return found.select(by, F.col("w.start").alias("start"), "last", "n")


def unexpired(rows: DataFrame, created: str, ttl_seconds: int, as_of: Column) -> DataFrame:
    """Rows that have not outlived their time: expired only if now is past it."""
    return rows.where(F.unix_timestamp(as_of) <= F.unix_timestamp(created) + ttl_seconds)


def threshold(rate: Column, size: Column, rows: Column) -> Column:
    """Update threshold in percent: base by project size, shifted by the recent success rate, from 20 to 80."""
    base = F.when(size < 50, 30).when(size < 200, 50).when(size < 500, 65).otherwise(75)
    shift = F.when(rows < 3, 0).when(rate > 0.9, -5).when(rate < 0.5, 10).when(rate < 0.7, 5).otherwise(0)
    return F.greatest(F.lit(20), F.least(F.lit(80), base + shift))


def without_oldest(rows: DataFrame, at: str, key: str, share: int) -> DataFrame:
    """``rows`` without the oldest 1 / ``share`` of them by (at, key).

    Counts by hour find the hour in which the border lies; only that hour's rows are ranked.
    """
    n = rows.count() // share
    hour = F.date_trunc("hour", at)
    counts = rows.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.orderBy("hour"))
    border = counts.withColumn("t", total).where(F.col("t") >= n).orderBy("hour").limit(1)
    border = border.select(F.col("hour").alias("__hour"), (F.lit(n) - F.col("t") + F.col("c")).alias("__k"))
    near = rows.crossJoin(F.broadcast(border))
    after = near.where(hour > F.col("__hour"))
    rank = F.row_number().over(Window.partitionBy("__hour").orderBy(at, key))
    within = near.where(hour == F.col("__hour")).withColumn("__r", rank).where(F.col("__r") > F.col("__k")).drop("__r")
    return after.unionByName(within).drop("__hour", "__k")
