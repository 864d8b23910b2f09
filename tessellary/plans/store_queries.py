"""Round trips of logs, versions and caches through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored
from ..sources.shared import shared_dir
from .registry import Tables, query


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("log_round_trip", """SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-02-05 12:00:00'""")
def log_round_trip(t: Tables) -> DataFrame:
    """Events saved as a log, those of one type twice, and read again for some days."""
    rows = t.events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    store = stored.log_store(t.spark, _folder(t, "log"), rows.schema, "event_id", "ts")
    store.save(rows)
    store.save(rows.where("event_type = 'error'"))
    first, last = (F.lit(x).cast("timestamp") for x in ("2024-01-10 00:00:00", "2024-02-05 12:00:00"))
    return stored.logged(store, "ts", first, last).select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("version_round_trip", """
    WITH v AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, o_orderkey, o_totalprice FROM orders)
    SELECT o_custkey, version, o_orderkey, CASE WHEN version = 1 THEN 0.0::DOUBLE ELSE CAST(o_totalprice AS DOUBLE) END AS price FROM v
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY version DESC) BETWEEN 2 AND 4""")
def version_round_trip(t: Tables) -> DataFrame:
    """Orders as versions of their customers' pages, the first one saved again with another price; the second to fourth newest of each."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    rows = t.orders.select("o_custkey", number.alias("version"), "o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    store = stored.version_store(t.spark, _folder(t, "versions"), rows.schema, "o_custkey", "version")
    store.save(rows)
    store.save(rows.where("version = 1").withColumn("price", F.lit(0.0)))
    return stored.versions_of(store, t.orders.select("o_custkey"), newest=3, skip=1)


@query("cache_round_trip", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL")
def cache_round_trip(t: Tables) -> DataFrame:
    """Hashes of texts cached; a third of the texts has changed since."""
    hashed = lambda text: t.documents.where("text is not null").select("doc_id", F.md5(text.cast("binary")).alias("hash"))
    before = hashed(F.col("text"))
    store = stored.cache_store(t.spark, _folder(t, "cache"), before.schema, "doc_id")
    store.save(before)
    now = hashed(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return stored.unchanged(store, now, "doc_id", "hash").select("doc_id")
