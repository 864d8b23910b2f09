"""Structured Streaming over an event table replayed from files."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_dir


def read(spark: SparkSession, path: str, like: DataFrame, at: str = "ts") -> DataFrame:
    """A stream of the files that match ``path``, with the schema of ``like`` and event times as instants."""
    return spark.readStream.schema(like.schema).parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def windowed(stream: DataFrame, width: str, late: str, by: list[str], at: str = "ts", slide: str | None = None) -> DataFrame:
    """Counts and sums of value in event-time windows; rows later than ``late`` are left out, windows close with the watermark."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    found = stream.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "v")


def debounced(stream: DataFrame, gap: str, late: str, by: str, at: str = "ts") -> DataFrame:
    """One row for each burst of events of a key that ``gap`` of silence ends."""
    w = F.session_window(at, gap)
    found = stream.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def leases(stream: DataFrame, resource: str, owner: str, request: str, seconds: int, at: str = "ts") -> DataFrame:
    """(request, granted): exclusive leases; a request is granted if the lease is free, run out, or the asker's own, which extends it."""
    kind = stream.schema
    out = f"`{request}` {kind[request].dataType.simpleString()}, granted boolean"

    def step(key: tuple, batches, state: GroupState):  # noqa: ANN001, ANN202
        held, until = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(batches)).sort_values([at, request])
        granted = []
        for r in rows.itertuples():
            now = getattr(r, at).timestamp()
            who = str(getattr(r, owner))
            free = held is None or now > until or who == held
            if free:
                held, until = who, now + seconds
            granted.append(free)
        state.update((held, until))
        yield pd.DataFrame({request: rows[request].values, "granted": granted})

    return stream.groupBy(resource).applyInPandasWithState(step, out, "held string, until double", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all that is there, write it to Parquet in the shared folder and return the table."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
