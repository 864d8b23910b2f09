"""Logs and history: events as interactions, audit entries and cache accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import logs
from .registry import Tables, query

_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def stamp(c: str):  # noqa: ANN201 - a column
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("audit_query", f"""SELECT event_id, {_STAMP.format('ts')} AS ts, event_type FROM events WHERE event_type IN ('purchase', 'signup')
    AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY events.ts DESC, event_id LIMIT 50 OFFSET 20""")
def audit_query(t: Tables) -> DataFrame:
    rows = t.events.where("event_type in ('purchase', 'signup') and ts >= timestamp'2024-01-05' and ts <= timestamp'2024-01-20'")
    return logs.page(rows, [F.desc("ts"), F.col("event_id")], 50, 20).select("event_id", stamp("ts").alias("ts"), "event_type")


@query("recent_interactions", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 25")
def recent_interactions(t: Tables) -> DataFrame:
    return logs.page(t.events, [F.desc("ts"), F.col("event_id")], 25).select("event_id", "user_id")


@query("interaction_counts", """WITH k AS (SELECT unnest(['signup', 'purchase', 'view', 'click', 'error', 'decision']) AS event_type)
    SELECT event_type, count(event_id) AS n FROM k LEFT JOIN events USING (event_type) GROUP BY event_type""")
def interaction_counts(t: Tables) -> DataFrame:
    return logs.counts_with_zeros(t.events, "event_type", ["signup", "purchase", "view", "click", "error", "decision"])


@query("interaction_stats", """SELECT count(*) AS total, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
    CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, count(DISTINCT user_id) AS users FROM events""")
def interaction_stats(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    ok = (F.col("event_type") != "error").cast("double")
    return t.events.agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(ok), 6).alias("success_rate"), F.sum(k).alias("tokens"), F.count_distinct("user_id").alias("users"))


@query("top_tools", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5")
def top_tools(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(5)


@query("failure_gaps", "SELECT user_id, count(*) AS failures, round(avg(value), 6) AS mean_value FROM events WHERE event_type = 'error' GROUP BY user_id")
def failure_gaps(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("failures"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("score_trend", """WITH s AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT event_id, CASE WHEN before IS NULL THEN 'stable' WHEN value - before > 5 THEN 'improving' WHEN value - before < -5 THEN 'declining' ELSE 'stable' END AS trend FROM s""")
def score_trend(t: Tables) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    d = F.col("value") - F.col("before")
    rows = t.events.withColumn("before", before)
    return rows.select("event_id", F.when(d > 5, "improving").when(d < -5, "declining").otherwise("stable").alias("trend"))


_RATE = """r AS (SELECT event_id, user_id, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) OVER w AS rate, count(*) OVER w AS n
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def _rates(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    ok = (F.col("event_type") != "error").cast("double")
    return t.events.select("event_id", "user_id", F.avg(ok).over(w).alias("rate"), F.count(F.lit(1)).over(w).alias("n"))


@query("recent_success_rate", f"WITH {_RATE} SELECT event_id, round(rate, 6) AS rate FROM r")
def recent_success_rate(t: Tables) -> DataFrame:
    return _rates(t).select("event_id", F.round("rate", 6).alias("rate"))


@query("adaptive_threshold", f"""WITH {_RATE} SELECT event_id, CAST(greatest(20, least(80, CASE WHEN user_id < 50 THEN 30 WHEN user_id < 200 THEN 50 WHEN user_id < 500 THEN 65 ELSE 75 END
    + CASE WHEN n < 3 THEN 0 WHEN rate > 0.9 THEN -5 WHEN rate < 0.5 THEN 10 WHEN rate < 0.7 THEN 5 ELSE 0 END)) AS INT) AS threshold FROM r""")
def adaptive_threshold(t: Tables) -> DataFrame:
    return _rates(t).select("event_id", logs.threshold(F.col("rate"), F.col("user_id"), F.col("n")).alias("threshold"))


_ISLANDS = """i AS (SELECT conv_id, turn, role, text, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM i)"""


@query("role_islands", f"""WITH {_ISLANDS}, j AS (SELECT conv_id, CAST(island AS INT) AS island, min(role) AS role, string_agg(text, ' ' ORDER BY turn) AS body FROM g GROUP BY conv_id, island)
    SELECT conv_id, island, role, CASE WHEN length(body) > 100 THEN substr(body, 1, 100) || '...' ELSE body END AS summary FROM j""")
def role_islands(t: Tables) -> DataFrame:
    found = logs.islands(t.conversations, "conv_id", "turn", "role")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    grouped = found.groupBy("conv_id", "island").agg(F.min("role").alias("role"), joined.alias("body"))
    return grouped.select("conv_id", "island", "role", tx.truncated(F.col("body"), 100).alias("summary"))


@query("sliding_window_tail", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def sliding_window_tail(t: Tables) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return t.conversations.withColumn("r", rank).where("r <= 3").select("conv_id", "turn")


@query("conversation_tokens", "SELECT conv_id, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, count(*) AS messages FROM conversations GROUP BY conv_id")
def conversation_tokens(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.sum(tx.token_estimate(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("messages"))


_NOW = "(SELECT max(ts) FROM events)"


def _with_now(t: Tables) -> DataFrame:
    return t.events.crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("now"))))


@query("ttl_filter", f"SELECT event_id FROM events WHERE epoch_ms({_NOW}) // 1000 <= epoch_ms(ts) // 1000 + 86400")
def ttl_filter(t: Tables) -> DataFrame:
    return logs.unexpired(_with_now(t), "ts", 86400, F.col("now")).select("event_id")


@query("ttl_expired_count", f"SELECT event_type, count(*) AS expired FROM events WHERE epoch_ms({_NOW}) // 1000 > epoch_ms(ts) // 1000 + 3600 GROUP BY event_type")
def ttl_expired_count(t: Tables) -> DataFrame:
    late = F.unix_timestamp("now") > F.unix_timestamp("ts") + 3600
    return _with_now(t).where(late).groupBy("event_type").agg(F.count(F.lit(1)).alias("expired"))


@query("hot_keys", "SELECT user_id, event_type, count(*) AS hits FROM events GROUP BY 1, 2 HAVING count(*) >= 5")
def hot_keys(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("hits")).where("hits >= 5")


@query("counts_by_type_and_source", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
def counts_by_type_and_source(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", "user_id")
    return rows.groupingSets([["event_type"], ["user_id"], []], "event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("retention_cutoff", f"""WITH a AS (SELECT user_id, max(ts) AS last, count(*) AS n, avg(value) AS relevance FROM events GROUP BY user_id)
    SELECT user_id FROM a WHERE (epoch_ms({_NOW}) - epoch_ms(last)) / 86400000.0 > 0.05 AND relevance < 60 AND n < 80""")
def retention_cutoff(t: Tables) -> DataFrame:
    a = t.events.groupBy("user_id").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("relevance"))
    now = a.crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("now"))))
    days = (F.unix_millis(F.col("now").cast("timestamp")) - F.unix_millis(F.col("last").cast("timestamp"))) / 86400000.0
    return now.where((days > 0.05) & (F.col("relevance") < 60) & (F.col("n") < 80)).select("user_id")


@query("relevance_boost", "SELECT user_id, round(CASE WHEN count(*) >= 60 THEN least(avg(value) / 100 * 1.5, 1.0) ELSE avg(value) / 100 END, 6) AS relevance FROM events GROUP BY user_id")
def relevance_boost(t: Tables) -> DataFrame:
    mean = F.avg("value") / 100
    rows = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), mean.alias("m"))
    return rows.select("user_id", F.round(F.when(F.col("n") >= 60, F.least(F.col("m") * 1.5, F.lit(1.0))).otherwise(F.col("m")), 6).alias("relevance"))


@query("evict_oldest_tenth", "SELECT event_id FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events) WHERE r > floor(n / 10.0)")
def evict_oldest_tenth(t: Tables) -> DataFrame:
    return logs.without_oldest(t.events, "ts", "event_id", 10).select("event_id")


@query("debounce_sessions", f"""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 300 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s)
    SELECT user_id, {_STAMP.format('min(ts)')} AS start, {_STAMP.format('max(ts)')} AS last, count(*) AS n FROM g GROUP BY user_id, s""")
def debounce_sessions(t: Tables) -> DataFrame:
    return logs.sessions(t.events, "user_id", "ts", 300).select("user_id", stamp("start").alias("start"), stamp("last").alias("last"), "n")


@query("inactive_sessions", f"""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1800 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s),
    x AS (SELECT user_id, max(ts) AS last, count(*) AS n FROM g GROUP BY user_id, s)
    SELECT user_id, {_STAMP.format('last')} AS last, n FROM x WHERE last < {_NOW} - INTERVAL 1800 SECOND""")
def inactive_sessions(t: Tables) -> DataFrame:
    found = logs.sessions(t.events, "user_id", "ts", 1800).crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("now"))))
    return found.where("last < now - interval 1800 seconds").select("user_id", stamp("last").alias("last"), "n")


@query("tumbling_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def tumbling_counts(t: Tables) -> DataFrame:
    found = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return found.select(stamp("w.start").alias("start"), "event_type", "n", "v")


@query("lease_grants")
def lease_grants(t: Tables) -> DataFrame:
    """Exclusive leases of 10 minutes on each event type: a request is granted if the lease is free or is the asker's own, which extends it."""
    import pandas as pd

    def grant(rows: pd.DataFrame) -> pd.DataFrame:
        owner, until, out = None, pd.Timestamp.min, []
        for r in rows.sort_values(["ts", "event_id"]).itertuples():
            free = owner is None or r.ts > until or owner == r.user_id
            if free:
                owner, until = r.user_id, r.ts + pd.Timedelta(minutes=10)
            out.append((r.event_id, free))
        return pd.DataFrame(out, columns=["event_id", "granted"])

    day = t.events.withColumn("day", F.to_date("ts"))
    return day.groupBy("event_type", "day").applyInPandas(lambda rows: grant(rows), "event_id long, granted boolean")
