"""Change detection: orders as files of two snapshots, part-supplier lines as dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes
from .registry import Tables, query

# The old snapshot ends with 1997, the new one begins with 1993; urgent orders were rewritten in between.
_SNAP = """
    old AS (SELECT o_orderkey AS k, md5(concat_ws('|', o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR))) AS h
            FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
    new AS (SELECT o_orderkey AS k, md5(concat_ws('|', CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END, o_orderpriority, CAST(o_custkey AS VARCHAR))) AS h
            FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01'),
    d AS (SELECT k, CASE WHEN old.h IS NULL THEN 'added' WHEN new.h IS NULL THEN 'deleted' WHEN old.h <> new.h THEN 'modified' ELSE 'unchanged' END AS change,
                 old.h AS old_hash, new.h AS new_hash FROM old FULL JOIN new USING (k))"""


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus"))
    rest = ("o_orderpriority", "o_custkey")
    old = t.orders.where("o_orderdate < '1998-01-01'").select(F.col("o_orderkey").alias("k"), changes.content_hash(F.col("o_orderstatus"), *map(F.col, rest)).alias("h"))
    new = t.orders.where("o_orderdate >= '1993-01-01'").select(F.col("o_orderkey").alias("k"), changes.content_hash(status, *map(F.col, rest)).alias("h"))
    return old, new


@query("snapshot_diff", f"WITH {_SNAP} SELECT k, change, old_hash, new_hash FROM d WHERE change <> 'unchanged'")
def snapshot_diff(t: Tables) -> DataFrame:
    return changes.snapshot_diff(*snapshots(t), "k", "h")


@query("change_summary", f"""WITH {_SNAP} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified,
    count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change <> 'unchanged') AS total FROM d""")
def change_summary(t: Tables) -> DataFrame:
    return changes.summary(changes.snapshot_diff(*snapshots(t), "k", "h"))


@query("change_percentage", f"WITH {_SNAP} SELECT count(*) FILTER (change <> 'unchanged') AS changed, count(*) AS total, round(count(*) FILTER (change <> 'unchanged') * 100.0 / count(*), 6) AS percentage FROM d")
def change_percentage(t: Tables) -> DataFrame:
    return changes.change_percentage(*snapshots(t), "k", "h").withColumn("percentage", F.round("percentage", 6))


@query("update_mode", f"""WITH {_SNAP}, c AS (SELECT count(*) FILTER (change <> 'unchanged') AS n, count(*) FILTER (change <> 'unchanged') * 100.0 / count(*) AS p FROM d)
    SELECT CASE WHEN n = 0 THEN 'none' WHEN p <= 50 THEN 'incremental' ELSE 'full' END AS mode FROM c""")
def update_mode(t: Tables) -> DataFrame:
    p = changes.change_percentage(*snapshots(t), "k", "h")
    return p.select(F.when(F.col("changed") == 0, "none").when(F.col("percentage") <= 50, "incremental").otherwise("full").alias("mode"))


@query("affected_pages", f"""WITH {_SNAP} SELECT DISTINCT l_partkey AS page FROM lineitem WHERE l_orderkey IN (SELECT k FROM d WHERE change = 'modified')""")
def affected_pages(t: Tables) -> DataFrame:
    changed = changes.snapshot_diff(*snapshots(t), "k", "h").where("change = 'modified'").select(F.col("k").alias("l_orderkey"))
    return changes.affected_pages(t.lineitem, changed, "l_partkey", "l_orderkey").select(F.col("l_partkey").alias("page"))


@query("affected_pages_by_category", f"""WITH {_SNAP} SELECT DISTINCT l_partkey AS page FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE l_orderkey IN (SELECT k FROM d WHERE change = 'modified') OR (p_size = 1 AND EXISTS (SELECT 1 FROM d WHERE change IN ('added', 'deleted')))""")
def affected_pages_by_category(t: Tables) -> DataFrame:
    d = changes.snapshot_diff(*snapshots(t), "k", "h")
    direct = changes.affected_pages(t.lineitem, d.where("change = 'modified'").select(F.col("k").alias("l_orderkey")), "l_partkey", "l_orderkey")
    structural = d.where("change in ('added', 'deleted')").limit(1).select(F.lit(True).alias("any"))
    overview = t.part.where("p_size = 1").join(t.lineitem, F.col("p_partkey") == F.col("l_partkey"), "left_semi").crossJoin(F.broadcast(structural))
    known = t.part.select(F.col("p_partkey").alias("l_partkey"))
    return direct.join(known, "l_partkey", "left_semi").union(overview.select("p_partkey")).distinct().select(F.col("l_partkey").alias("page"))


@query("affected_one_hop", f"""WITH {_SNAP}, c AS (SELECT k FROM d WHERE change = 'added')
    SELECT DISTINCT id FROM (SELECT 'order:' || k AS id FROM c UNION ALL SELECT 'part:' || l_partkey FROM lineitem WHERE l_orderkey IN (SELECT k FROM c))""")
def affected_one_hop(t: Tables) -> DataFrame:
    added = changes.snapshot_diff(*snapshots(t), "k", "h").where("change = 'added'").select(F.concat(F.lit("order:"), "k").alias("id"))
    edges = t.lineitem.select(F.concat(F.lit("part:"), "l_partkey").alias("src"), F.concat(F.lit("order:"), "l_orderkey").alias("dst"))
    return changes.one_hop(added, edges)


@query("rename_detect", """
    WITH h AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents), o AS (SELECT h, max(doc_id) AS old_key FROM h WHERE doc_id % 2 = 0 GROUP BY h)
    SELECT old_key, max(doc_id) AS new_key FROM o JOIN h USING (h) WHERE doc_id % 2 = 1 GROUP BY old_key""")
def rename_detect(t: Tables) -> DataFrame:
    """Even ids are the old files, odd ones the new: two snapshots that make up the whole table."""
    docs = t.documents.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    return changes.renames(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "h")


@query("dedupe_exact", "SELECT md5(coalesce(text, '')) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedupe_exact(t: Tables) -> DataFrame:
    return changes.exact_copies(t.documents, "doc_id", "text")


@query("hash_fingerprints", """
    SELECT o_orderkey, substr(md5(concat_ws('|', o_orderstatus, o_orderpriority)), 1, 16) AS file_hash, sha256(o_orderstatus || ':' || o_orderpriority || ':default') AS cache_key FROM orders""")
def hash_fingerprints(t: Tables) -> DataFrame:
    key = F.concat_ws(":", "o_orderstatus", "o_orderpriority", F.lit("default"))
    return t.orders.select(
        "o_orderkey", changes.content_hash(F.col("o_orderstatus"), F.col("o_orderpriority"), length=16).alias("file_hash"), F.sha2(key.cast("binary"), 256).alias("cache_key")
    )


@query("symbol_hash", """SELECT l_orderkey, md5(string_agg(CAST(l_partkey AS VARCHAR) || ':' || l_returnflag, '|' ORDER BY CAST(l_partkey AS VARCHAR) || ':' || l_returnflag)) AS hash FROM lineitem GROUP BY l_orderkey""")
def symbol_hash(t: Tables) -> DataFrame:
    parts = F.collect_list(F.concat_ws(":", F.col("l_partkey").cast("string"), "l_returnflag"))
    return t.lineitem.groupBy("l_orderkey").agg(changes.sorted_hash(parts).alias("hash"))


@query("latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_per_key(t: Tables) -> DataFrame:
    return changes.latest(t.orders, "o_custkey", "o_orderkey", "o_orderdate")


@query("keep_top_n_versions", """SELECT o_custkey, o_orderkey, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3""")
def keep_top_n_versions(t: Tables) -> DataFrame:
    kept = changes.newest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)
    return kept.select("o_custkey", "o_orderkey", "rank")


@query("positional_line_diff", """
    WITH p AS (SELECT a.conv_id AS k, string_split(a.text, chr(10)) AS o, string_split(b.text, chr(10)) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
    x AS (SELECT k, unnest(o) AS old_line, generate_subscripts(o, 1) - 1 AS line FROM p), y AS (SELECT k, unnest(n) AS new_line, generate_subscripts(n, 1) - 1 AS line FROM p)
    SELECT k, CAST(line AS INT) AS line, CASE WHEN old_line IS NULL THEN 'added' WHEN new_line IS NULL THEN 'removed' ELSE 'changed' END AS change, old_line, new_line
    FROM x FULL JOIN y USING (k, line) WHERE old_line IS DISTINCT FROM new_line""")
def positional_line_diff(t: Tables) -> DataFrame:
    side = lambda turn, name: t.conversations.where(F.col("turn") == turn).select(F.col("conv_id").alias("k"), F.col("text").alias(name))
    return changes.line_diff(side(0, "old").join(side(1, "new"), "k"), "k", "old", "new")


@query("section_upsert", """
    WITH o AS (SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS body FROM conversations WHERE turn < 2 GROUP BY 1, 2), n AS (SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS body FROM conversations WHERE turn >= 2 GROUP BY 1, 2)
    SELECT conv_id, role, md5(coalesce(n.body, o.body)) AS body FROM o FULL JOIN n USING (conv_id, role)""")
def section_upsert(t: Tables) -> DataFrame:
    def side(condition: str) -> DataFrame:
        texts = F.array_sort(F.collect_list(F.struct("turn", "text")))
        grouped = t.conversations.where(condition).groupBy("conv_id", "role").agg(texts.alias("x"))
        return grouped.select("conv_id", "role", F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("body"))

    merged = changes.merge_sections(side("turn < 2"), side("turn >= 2"), ["conv_id", "role"], "body")
    return merged.withColumn("body", F.md5(F.col("body").cast("binary")))


@query("new_sections_only", "SELECT DISTINCT conv_id, text FROM conversations b WHERE turn = 2 AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = b.conv_id AND a.turn < 2 AND a.text = b.text)")
def new_sections_only(t: Tables) -> DataFrame:
    old = t.conversations.where("turn < 2").select("conv_id", "text")
    return t.conversations.where("turn = 2").select("conv_id", "text").distinct().join(old, ["conv_id", "text"], "left_anti")


@query("line_membership_diff", """
    WITH a AS (SELECT conv_id, unnest(string_split(text, '. ')) AS s FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, unnest(string_split(text, '. ')) AS s FROM conversations WHERE role = 'assistant')
    SELECT conv_id, count(*) AS only_old FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY conv_id""")
def line_membership_diff(t: Tables) -> DataFrame:
    side = lambda role: t.conversations.where(F.col("role") == role).select("conv_id", F.explode(F.split("text", r"\. ")).alias("s"))
    return side("user").distinct().join(side("assistant"), ["conv_id", "s"], "left_anti").groupBy("conv_id").agg(F.count(F.lit(1)).alias("only_old"))
