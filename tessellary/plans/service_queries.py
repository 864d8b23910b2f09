"""Rules, plans, reminders and exports over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import changes, graph, services
from ..sources import export
from .registry import Tables, query

_RULES = [("AFRICA", "ASIA", False), ("AFRICA", "*", True), ("*", "EUROPE", False), ("*", "*", True)]
_RULES_SQL = "rules(rs, rd, allowed) AS (VALUES " + ", ".join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in _RULES) + ")"


@query("dependency_rules", f"""WITH {_RULES_SQL}, p AS (SELECT a.r_name AS src, b.r_name AS dst FROM region a, region b),
    m AS (SELECT src, dst, allowed, row_number() OVER (PARTITION BY src, dst ORDER BY (CASE WHEN rs = '*' THEN 2 ELSE 0 END) + (CASE WHEN rd = '*' THEN 1 ELSE 0 END)) AS k FROM p JOIN rules ON rs IN (src, '*') AND rd IN (dst, '*'))
    SELECT src, dst, allowed FROM m WHERE k = 1""")
def dependency_rules(t: Tables) -> DataFrame:
    """Regions are a fixed handful of modules; every pair of them is checked."""
    pairs = t.region.select(F.col("r_name").alias("src")).crossJoin(F.broadcast(t.region.select(F.col("r_name").alias("dst"))))
    rules = t.spark.createDataFrame(_RULES, "rule_src string, rule_dst string, allowed boolean")
    return services.most_specific(pairs, rules, [])


@query("permission_filter", """WITH acl AS (SELECT s_suppkey AS page, s_nationkey AS u, CASE WHEN s_acctbal > 5000 THEN ['read', 'edit'] ELSE ['read'] END AS own FROM supplier)
    SELECT n_nationkey AS "user", s_suppkey AS page FROM nation JOIN supplier ON true LEFT JOIN acl ON acl.page = s_suppkey AND acl.u = n_nationkey
    WHERE list_contains(coalesce(own, CASE WHEN n_regionkey = 0 THEN ['read', 'edit'] ELSE ['read'] END), 'edit')""")
def permission_filter(t: Tables) -> DataFrame:
    users = t.nation.select(F.col("n_nationkey").alias("user"), F.when(F.col("n_regionkey") == 0, "editor").otherwise("reader").alias("role"))
    roles = t.spark.createDataFrame([("editor", ["read", "edit"]), ("reader", ["read"])], "role string, permissions array<string>")
    own = F.when(F.col("s_acctbal") > 5000, F.array(F.lit("read"), F.lit("edit"))).otherwise(F.array(F.lit("read")))
    acl = t.supplier.select(F.col("s_suppkey").alias("page"), F.col("s_nationkey").alias("user"), own.alias("permissions"))
    return services.permitted(t.supplier.select(F.col("s_suppkey").alias("page")), acl, roles, users, "edit")


@query("update_batches", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) - 1) // 5 AS INT) AS batch FROM orders")
def update_batches(t: Tables) -> DataFrame:
    return services.batches(t.orders, ["o_custkey"], ["o_orderpriority", "o_orderkey"], 5).select("o_orderkey", "batch")


@query("prioritized_updates", """SELECT page, priority FROM (SELECT l_partkey AS page, o_orderpriority AS priority, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderpriority, o_orderkey) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE k = 1""")
def prioritized_updates(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    best = rows.groupBy(F.col("l_partkey").alias("page")).agg(F.min(F.struct("o_orderpriority", "o_orderkey")).alias("b"))
    return best.select("page", F.col("b.o_orderpriority").alias("priority"))


@query("range_overlap", """WITH a AS (SELECT l_suppkey AS k, l_orderkey AS a_id, l_linenumber AS ln, CAST(l_quantity AS BIGINT) * 1000 AS a_start, CAST(l_quantity AS BIGINT) * 1000 + 500 AS a_end FROM lineitem),
    b AS (SELECT s_suppkey AS k, 10000 AS b_start, CAST(12000 + s_suppkey * 10 AS BIGINT) AS b_end FROM supplier) SELECT k, a_id, ln FROM a JOIN b USING (k) WHERE a_start <= b_end AND b_start <= a_end""")
def range_overlap(t: Tables) -> DataFrame:
    start = F.col("l_quantity").cast("long") * 1000
    a = t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("a_id"), F.col("l_linenumber").alias("ln"), start.alias("a_start"), (start + 500).alias("a_end"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.lit(10000).cast("long").alias("b_start"), (F.col("s_suppkey") * 10 + 12000).alias("b_end"))
    return services.overlapping(a, b, "k", 4000).select("k", "a_id", "ln")


@query("prefix_affected_pages", """WITH p AS (SELECT page_id, array_to_string(list_slice(string_split(url, '/'), 1, 4), '/') AS dir FROM pages) SELECT dir, count(*) AS n, min(page_id) AS first FROM p GROUP BY dir""")
def prefix_affected_pages(t: Tables) -> DataFrame:
    """Pages under a directory: the prefix join as an equality on exploded ancestors."""
    up = t.pages.select("page_id", F.explode(services.ancestors(F.col("url"))).alias("dir"), F.slice(F.split("url", "/"), 1, 4).alias("four"))
    return up.where(F.col("dir") == F.array_join("four", "/")).groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))


@query("outdated_docs", """WITH r AS (SELECT l_partkey, o_orderdate, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    a AS (SELECT l_partkey AS page, count(*) AS changes, max(o_orderdate) AS last FROM r WHERE k <= 10 GROUP BY 1), s AS (SELECT page, changes, floor((epoch_ms(TIMESTAMP '1998-12-31') - epoch_ms(last)) / 86400000.0) AS days FROM a)
    SELECT page, changes, CAST(days AS BIGINT) AS days, round(0.5 * least(days / 90.0, 1.0) + 0.5 * least(changes / 20.0, 1.0), 6) AS score FROM s""")
def outdated_docs(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "o_orderdate", "l_orderkey", "l_linenumber")
    kept = changes.newest(rows, ["l_partkey"], [F.desc("o_orderdate"), F.desc("l_orderkey"), F.desc("l_linenumber")], 10)
    a = kept.groupBy(F.col("l_partkey").alias("page")).agg(F.count(F.lit(1)).alias("changes"), F.max("o_orderdate").alias("last"))
    days = F.floor((F.unix_timestamp(F.lit("1998-12-31 00:00:00")) - F.unix_timestamp("last")) / 86400)
    return a.withColumn("days", days).select("page", "changes", "days", F.round(services.outdated_score(F.col("days"), F.col("changes")), 6).alias("score"))


@query("update_strategy", """WITH p AS (SELECT o_custkey, count(*) AS changes, count(DISTINCT l_partkey) AS pages FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey)
    SELECT o_custkey, CASE WHEN changes > 100 OR pages > 50 THEN 'full' WHEN changes > 20 OR pages > 10 THEN 'incremental' ELSE 'selective' END AS strategy, CAST(100 * changes + 50 * pages AS BIGINT) AS millis FROM p""")
def update_strategy(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    p = rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("l_partkey").alias("pages"))
    return p.select("o_custkey", services.strategy(F.col("changes"), F.col("pages")).alias("strategy"), (F.col("changes") * 100 + F.col("pages") * 50).alias("millis"))


@query("sync_health", """WITH c AS (SELECT s_nationkey, count(*) FILTER (n >= 600) AS high, count(*) FILTER (n BETWEEN 590 AND 599) AS medium, count(*) FILTER (n >= 590) AS total FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
    h AS (SELECT s_nationkey, greatest(0, 100 - 20 * high - 10 * medium - 5 * total) AS health FROM c) SELECT s_nationkey, CAST(health AS BIGINT) AS health, CASE WHEN health < 50 THEN 'critical' WHEN health < 80 THEN 'warning' ELSE 'healthy' END AS status FROM h""")
def sync_health(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    c = n.groupBy("s_nationkey").agg(F.count_if(F.col("n") >= 600).alias("high"), F.count_if(F.col("n").between(590, 599)).alias("medium"), F.count_if(F.col("n") >= 590).alias("total"))
    h = c.select("s_nationkey", services.sync_health(F.col("high"), F.col("medium"), F.col("total")).alias("health"))
    return h.select("s_nationkey", F.col("health").cast("long").alias("health"), F.when(F.col("health") < 50, "critical").when(F.col("health") < 80, "warning").otherwise("healthy").alias("status"))


@query("severity_forward_fill", "SELECT event_id, last_value(CASE WHEN event_type IN ('error', 'signup') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS severity FROM events")
def severity_forward_fill(t: Tables) -> DataFrame:
    rows = t.events.withColumn("severity", F.when(F.col("event_type").isin("error", "signup"), F.col("event_type")))
    return services.filled_forward(rows, "user_id", "event_id", "severity").select("event_id", "severity")


@query("toc_parents", """WITH h AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 6 + 1 AS level FROM lineitem)
    SELECT a.l_orderkey, a.l_linenumber, (SELECT max(b.l_linenumber) FROM h b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber < a.l_linenumber AND b.level < a.level) AS parent FROM h a""")
def toc_parents(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 6 + 1).alias("level"))
    return services.parents(rows, "l_orderkey", "l_linenumber", "level").select("l_orderkey", "l_linenumber", "parent")


@query("top_three_per_type", "SELECT event_type, event_id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3")
def top_three_per_type(t: Tables) -> DataFrame:
    return changes.newest(t.events, ["event_type"], [F.desc("value"), F.col("event_id")], 3).select("event_type", "event_id", "rank")


@query("manifest", "SELECT doc_id AS page, substr(md5(coalesce(text, '')), 1, 16) AS hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents")
def manifest(t: Tables) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return t.documents.select(F.col("doc_id").alias("page"), F.substring(F.md5(text), 1, 16).alias("hash"), F.octet_length(text).cast("long").alias("size"))


@query("valid_snapshots", "SELECT o_orderkey FROM orders WHERE substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 1) = substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 1) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def valid_snapshots(t: Tables) -> DataFrame:
    first = lambda c: F.substring(F.sha2(F.col(c).cast("string").cast("binary"), 256), 1, 1)
    return t.orders.where(first("o_orderkey") == first("o_custkey")).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey")


@query("contributor_upsert", "SELECT c_custkey, count(o_orderkey) AS contributions, coalesce(strftime(max(o_orderdate), '%Y-%m-%d'), 'never') AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def contributor_upsert(t: Tables) -> DataFrame:
    done = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"))
    return t.customer.select("c_custkey").join(done, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("contributions"), F.coalesce("last", F.lit("never")).alias("last"))


@query("suggestions_by_risk", """SELECT user_id, CASE WHEN e >= 18 THEN 'urgent' WHEN e >= 14 THEN 'high' WHEN e >= 10 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN e >= 18 THEN 1 WHEN e >= 14 THEN 3 WHEN e >= 10 THEN 7 ELSE 14 END AS days
    FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY user_id)""")
def suggestions_by_risk(t: Tables) -> DataFrame:
    e = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("e"))
    ladder = lambda a, b, c, d: F.when(F.col("e") >= 18, a).when(F.col("e") >= 14, b).when(F.col("e") >= 10, c).otherwise(d)
    return e.select("user_id", ladder("urgent", "high", "medium", "low").alias("priority"), ladder(1, 3, 7, 14).alias("days"))


@query("layer_dependencies", """SELECT CASE WHEN a.p_size < 10 THEN 'presentation' WHEN a.p_size < 30 THEN 'application' ELSE 'data' END AS layer, r_name AS target, count(*) AS n FROM lineitem JOIN part a ON p_partkey = l_partkey
    JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def layer_dependencies(t: Tables) -> DataFrame:
    layer = F.when(F.col("p_size") < 10, "presentation").when(F.col("p_size") < 30, "application").otherwise("data")
    rows = t.lineitem.select("l_partkey", "l_suppkey").join(t.part.select("p_partkey", layer.alias("layer")), F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy("layer", F.col("r_name").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("symbol_first_match", "SELECT l_partkey, arg_min(l_suppkey, (CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_orderkey, l_linenumber)) AS definition FROM lineitem GROUP BY l_partkey")
def symbol_first_match(t: Tables) -> DataFrame:
    """The preferred definition of a name: one of its own kind first, else the first in order."""
    order = F.struct(F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("p"), "l_orderkey", "l_linenumber")
    return t.lineitem.groupBy("l_partkey").agg(F.min_by("l_suppkey", order).alias("definition"))


@query("graph_export_lines", """SELECT line FROM (SELECT '  N' || n_nationkey || ' --> R' || n_regionkey AS line FROM nation UNION ALL SELECT '  N' || n_nationkey || '["' || n_name || '"]' FROM nation UNION ALL SELECT '  R' || r_regionkey || '["' || r_name || '"]' FROM region)""")
def graph_export_lines(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    nodes = nodes.union(t.region.select(F.concat(F.lit("R"), "r_regionkey"), "r_name"))
    edges = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("dst"))
    return export.mermaid_lines(nodes, edges)


@query("graph_grid_layout", """WITH n AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, ceil(sqrt(count(*) OVER (PARTITION BY s_nationkey))) AS w FROM supplier)
    SELECT s_suppkey, CAST(i % w AS INT) AS x, CAST(floor(i / w) AS INT) AS y FROM n""")
def graph_grid_layout(t: Tables) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    width = F.ceil(F.sqrt(F.count(F.lit(1)).over(Window.partitionBy("s_nationkey"))))
    rows = t.supplier.select("s_suppkey", at.alias("i"), width.alias("w"))
    return rows.select("s_suppkey", (F.col("i") % F.col("w")).cast("int").alias("x"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"))


@query("csv_export_lines", """SELECT '"' || p_partkey || '","' || replace(p_name, '"', '""') || '",' || p_size AS line FROM part""")
def csv_export_lines(t: Tables) -> DataFrame:
    return export.csv_lines(t.part.select(F.col("p_partkey").cast("string"), "p_name", "p_size"))


@query("parallel_levels", "SELECT o_custkey, CAST(ceil(count(*) / 5.0) AS INT) AS levels FROM orders GROUP BY o_custkey")
def parallel_levels(t: Tables) -> DataFrame:
    chunked = services.batches(t.orders, ["o_custkey"], ["o_orderpriority", "o_orderkey"], 5)
    return chunked.groupBy("o_custkey").agg((F.max("batch") + 1).alias("levels"))


@query("related_nodes", """WITH e AS (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS w FROM lineitem GROUP BY 1, 2), n AS (SELECT s AS id, w FROM e WHERE p = 1 UNION ALL SELECT b.s, b.w FROM e a JOIN e b ON a.s = b.p WHERE a.p = 1)
    SELECT id, CAST(sum(w) AS BIGINT) AS weight FROM n GROUP BY id""")
def related_nodes(t: Tables) -> DataFrame:
    e = graph.merged_edges(t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))
    near = e.where("src = 1").select(F.col("dst").alias("id"), "weight")
    far = e.join(near.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"), "weight")
    return near.union(far).groupBy("id").agg(F.sum("weight").alias("weight"))
