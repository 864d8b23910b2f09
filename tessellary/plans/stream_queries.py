"""Streaming queries: events replayed as a stream, results as the closed windows wrote them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import events, watch
from .registry import Tables, query

_FMT = "'%Y-%m-%d %H:%M:%S'"


def _stream(t: Tables) -> DataFrame:
    return events.read(t.spark, f"{t.sf_dir}/events*.parquet", t.events)


def stamp(c: str):  # noqa: ANN201 - a column
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("stream_tumbling_counts", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2)
    SELECT strftime(s, {_FMT}) AS start, event_type, n, round(v, 4) AS v FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)""")
def stream_tumbling_counts(t: Tables) -> DataFrame:
    out = events.run_to_table(events.windowed(_stream(t), "1 hour", "0 seconds", ["event_type"]))
    return out.select(stamp("start"), "event_type", "n", F.round("v", 4).alias("v"))


@query("stream_debounce", f"""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 300 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s), x AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 300 SECOND AS b, count(*) AS n FROM g GROUP BY user_id, s)
    SELECT user_id, strftime(a, {_FMT}) AS start, strftime(b, {_FMT}) AS "end", n FROM x WHERE b <= (SELECT max(ts) FROM events)""")
def stream_debounce(t: Tables) -> DataFrame:
    out = events.run_to_table(events.debounced(_stream(t), "300 seconds", "0 seconds", "user_id"))
    return out.select("user_id", stamp("start"), stamp("end"), "n")


@query("stream_lease_grants")
def stream_lease_grants(t: Tables) -> DataFrame:
    return events.run_to_table(events.leases(_stream(t), "event_type", "user_id", "event_id", 600))


@query("stream_changes", f"""WITH e AS (SELECT *, CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS branch FROM events),
    o AS (SELECT user_id, event_id, event_type, branch, lag(event_type) OVER w AS head_before, lag(branch) OVER w AS branch_before FROM e WHERE branch <> '2' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT CAST(user_id AS VARCHAR) AS key, event_id AS number, 'head-change' AS type, head_before AS before, event_type AS after FROM o WHERE head_before <> event_type
    UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, 'branch-change', branch_before, branch FROM o WHERE branch_before <> branch""")
def stream_changes(t: Tables) -> DataFrame:
    """Users watched for a new kind of event (their head) and a new class of value (their branch), the third class being ignored."""
    seen = _stream(t).select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("number"), F.col("event_type").alias("head"), (F.floor("value") % 3).cast("string").alias("branch"))
    with watch.timed_state(t.spark):
        return events.run_to_table(watch.changes(seen, "0 seconds", ("2",)))


@query("stream_reminders", f"""
    WITH e AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type IN ('error', 'purchase')),
    s AS (SELECT user_id, ts AS since, (SELECT min(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts > e.ts OR p.ts = e.ts AND p.event_id > e.event_id)) AS done
          FROM e WHERE event_type = 'error' AND coalesce(before, 'purchase') = 'purchase'),
    r AS (SELECT user_id, since, unnest(range(1, CAST(floor(epoch(coalesce(done, (SELECT max(ts) FROM events)) - since) / 86400) AS BIGINT) + 1)) AS k FROM s)
    SELECT CAST(user_id AS VARCHAR) AS key, strftime(since, {_FMT}) AS since, strftime(since + k * INTERVAL 1 DAY, {_FMT}) AS at FROM r""")
def stream_reminders(t: Tables) -> DataFrame:
    """A reminder a day for each user from an error on until the next purchase."""
    kind = F.col("event_type")
    outdated = F.when(kind == "error", True).when(kind == "purchase", False)
    seen = _stream(t).select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("number"), outdated.alias("outdated"))
    with watch.timed_state(t.spark):
        out = events.run_to_table(watch.reminders(seen, "0 seconds", 24 * 3600))
    return out.select("key", stamp("since"), stamp("at"))


@query("stream_sync", f"""SELECT user_id, event_id, event_type, strftime(ts, {_FMT}) AS ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_sync(t: Tables) -> DataFrame:
    """Each user's last event, kept up to date batch by batch; the table is the same if batches come again."""
    sync = watch.Sync(t.spark, ["user_id"], ["ts", "event_id"])
    watch.synced(_stream(t).select("user_id", "event_id", "event_type", "ts"), sync)
    return sync.table().select("user_id", "event_id", "event_type", stamp("ts"))
