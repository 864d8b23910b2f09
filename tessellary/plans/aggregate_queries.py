"""Statistics, conventions, joins with fallbacks and small text folds over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregates, changes, code_graph, quality
from .registry import Tables, query


@query("status_and_tag_counts", "SELECT o_orderstatus AS status, o_orderpriority AS tag, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def status_and_tag_counts(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("tag"))
    return rows.groupingSets([["status"], ["tag"], []], "status", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("code_reuse_ratio", "SELECT count(DISTINCT p_name) AS names, count(*) AS symbols, round(count(DISTINCT p_name) / count(*), 6) AS ratio FROM part")
def code_reuse_ratio(t: Tables) -> DataFrame:
    names, n = F.count_distinct("p_name"), F.count(F.lit(1))
    return t.part.agg(names.alias("names"), n.alias("symbols"), F.round(names / n, 6).alias("ratio"))


@query("modules_by_directory", "SELECT p_brand AS module, count(*) AS files, count(DISTINCT p_type) AS exports, list_sort(list_distinct(list(p_size))) AS sizes FROM part GROUP BY p_brand")
def modules_by_directory(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("module")).agg(F.count(F.lit(1)).alias("files"), F.count_distinct("p_type").alias("exports"), F.array_sort(F.collect_set("p_size")).alias("sizes"))


_PATTERNS = [("economy", "ECONOMY", "SMALL"), ("promo", "PROMO", "LARGE"), ("metal", "STEEL", "BRASS")]
_PATTERN_SQL = " UNION ALL ".join(
    f"""SELECT '{n}' AS pattern, 0.4 * least(sum(CAST(contains(upper(p_type), '{a}') AS INT)) / greatest(0.1 * count(*), 1), 1) + 0.3 * least(sum(CAST(contains(upper(p_type), '{b}') AS INT)) / greatest(0.2 * count(*), 1), 1)
    + 0.3 * least(sum(CAST(p_size > 40 AS INT)) / greatest(0.3 * count(*), 1), 1) AS c FROM part""" for n, a, b in _PATTERNS
)


@query("pattern_confidence", f"SELECT pattern, round(c, 6) AS confidence FROM ({_PATTERN_SQL}) WHERE c >= 0.3")
def pattern_confidence(t: Tables) -> DataFrame:
    """Indicators of each pattern counted in one pass; a confidence of 0.3 is the least that is reported."""
    n, kind = F.count(F.lit(1)), F.upper("p_type")
    share = lambda hits, part: F.least(F.sum(hits.cast("int")) / F.greatest(n * part, F.lit(1.0)), F.lit(1.0))
    found = t.part.agg(*((share(kind.contains(a), 0.1) * 0.4 + share(kind.contains(b), 0.2) * 0.3 + share(F.col("p_size") > 40, 0.3) * 0.3).alias(name) for name, a, b in _PATTERNS))
    rows = found.select(F.explode(F.array(*(F.struct(F.lit(name).alias("pattern"), F.col(name).alias("c")) for name, _, _ in _PATTERNS))).alias("x"))
    return rows.where("x.c >= 0.3").select("x.pattern", F.round("x.c", 6).alias("confidence"))


@query("page_index", """SELECT doc_id, CAST(len(regexp_split_to_array(text, '\\s+')) AS INT) AS words, substr(text, 1, 200) AS summary, source AS category FROM documents""")
def page_index(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.split("text", r"\s+", -1)).alias("words"), F.substring("text", 1, 200).alias("summary"), F.col("source").alias("category"))


@query("concepts", """WITH c AS (SELECT lower(unnest(string_split(p_name, ' '))) AS name, p_partkey, p_brand FROM part)
    SELECT name, count(*) AS n, count(DISTINCT p_partkey) AS pages, array_to_string(list_sort(list_distinct(list(p_brand))), '; ') AS descriptions, round(least(1.0, count(*) / 10.0), 6) AS importance FROM c WHERE length(name) > 2 GROUP BY name""")
def concepts(t: Tables) -> DataFrame:
    rows = t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("name"), "p_partkey", "p_brand").where("length(name) > 2")
    n = F.count(F.lit(1))
    return rows.groupBy("name").agg(
        n.alias("n"), F.count_distinct("p_partkey").alias("pages"), F.array_join(F.array_sort(F.collect_set("p_brand")), "; ").alias("descriptions"), F.round(F.least(F.lit(1.0), n / 10), 6).alias("importance")
    )


@query("merge_knowledge", """SELECT event_type || ':' || trim(lower(props)) AS key, count(*) AS sources, round(max(value), 6) AS confidence, min(event_id) AS first FROM events GROUP BY 1""")
def merge_knowledge(t: Tables) -> DataFrame:
    key = F.concat_ws(":", "event_type", F.trim(F.lower("props")))
    return t.events.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("sources"), F.round(F.max("value"), 6).alias("confidence"), F.min("event_id").alias("first"))


_DOMAINS = [("english", "the"), ("english", "with"), ("french", "que"), ("french", "dans"), ("german", "nicht"), ("german", "und"), ("spanish", "ción"), ("spanish", "los")]
_DOMAIN_SQL = "dim(domain, word) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _DOMAINS) + ")"


@query("business_domains", f"""WITH {_DOMAIN_SQL}, s AS (SELECT domain, count(*) AS score FROM documents JOIN dim ON contains(lower(text), word) GROUP BY domain)
    SELECT domain, score, round(least(score / (SELECT count(*) FROM documents), 1), 6) AS confidence FROM s ORDER BY score DESC, domain LIMIT 3""")
def business_domains(t: Tables) -> DataFrame:
    text, docs = F.lower("text"), t.documents
    hits = docs.agg(F.count(F.lit(1)).alias("n"), *(F.sum(text.contains(w).cast("int")).alias(f"w{i}") for i, (_, w) in enumerate(_DOMAINS)))
    rows = hits.select("n", F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), F.col(f"w{i}").alias("k")) for i, (d, _) in enumerate(_DOMAINS)))).alias("x"))
    scored = rows.groupBy("x.domain", "n").agg(F.sum("x.k").alias("score"))
    out = scored.select("domain", "score", F.round(F.least(F.col("score") / F.col("n"), F.lit(1.0)), 6).alias("confidence"))
    return out.orderBy(F.desc("score"), "domain").limit(3)


@query("dominant_conventions", """SELECT p_brand AS module, arg_max(x, (n, x)) AS convention, round(max(n) / sum(n), 6) AS confidence FROM (SELECT p_brand, string_split(p_type, ' ')[1] AS x, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY p_brand HAVING sum(n) >= 5""")
def dominant_conventions(t: Tables) -> DataFrame:
    n = t.part.groupBy("p_brand", F.split("p_type", " ")[0].alias("x")).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(F.col("p_brand").alias("module")).agg(F.max(F.struct("n", "x")).alias("b"), F.sum("n").alias("total"))
    return best.where("total >= 5").select("module", F.col("b.x").alias("convention"), F.round(F.col("b.n") / F.col("total"), 6).alias("confidence"))


@query("learned_patterns", """SELECT user_id, event_type, count(*) AS frequency, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, list_reverse(list(event_id ORDER BY event_id DESC)[1:10]) AS examples FROM events GROUP BY 1, 2""")
def learned_patterns(t: Tables) -> DataFrame:
    """Frequencies from all rows; the ten newest examples are ranked before they are gathered, so no group is collected whole."""
    rank = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("event_id")))
    kept = t.events.select("user_id", "event_type", "event_id", rank.alias("r")).where("r <= 10").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list("event_id")).alias("examples"))
    stats = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("frequency"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))
    return stats.join(kept, ["user_id", "event_type"]).select("user_id", "event_type", "frequency", "last_seen", "examples")


@query("cache_stats", """WITH h AS (SELECT user_id || ':' || event_type AS k, count(*) AS hits, min(ts) AS created FROM events GROUP BY 1)
    SELECT count(*) AS size, CAST(sum(hits) AS BIGINT) AS hits, round(sum(hits) / count(*), 6) AS hit_rate, strftime(min(created), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(created), '%Y-%m-%d %H:%M:%S') AS newest FROM h""")
def cache_stats(t: Tables) -> DataFrame:
    h = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("hits"), F.min("ts").alias("created"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    n = F.count(F.lit(1))
    return h.agg(n.alias("size"), F.sum("hits").alias("hits"), F.round(F.sum("hits") / n, 6).alias("hit_rate"), stamp(F.min("created")).alias("oldest"), stamp(F.max("created")).alias("newest"))


@query("common_dependencies", """SELECT l_suppkey AS dependency, count(DISTINCT l_partkey) AS files, round(least(count(DISTINCT l_partkey) / (SELECT count(*) FROM part) + 0.5, 1), 6) AS confidence FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2 ORDER BY files DESC, dependency LIMIT 5""")
def common_dependencies(t: Tables) -> DataFrame:
    total = t.part.agg(F.count(F.lit(1)).alias("total"))
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("dependency")).agg(F.count_distinct("l_partkey").alias("files")).where("files >= 2")
    best = n.orderBy(F.desc("files"), "dependency").limit(5).crossJoin(F.broadcast(total))
    return best.select("dependency", "files", F.round(F.least(F.col("files") / F.col("total") + 0.5, F.lit(1.0)), 6).alias("confidence"))


@query("link_resolution", """WITH l AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1))) AS slug FROM pages), s AS (SELECT lower(split_part(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ', 1)) AS slug, min(page_id) AS target FROM pages GROUP BY 1)
    SELECT DISTINCT l.page_id, s.target FROM l JOIN s USING (slug)""")
def link_resolution(t: Tables) -> DataFrame:
    """Links resolved by slug, the first word of a title; the first page of a slug wins."""
    links = t.pages.select("page_id", F.explode(F.transform(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)), lambda s: F.lower(s))).alias("slug"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    slugs = t.pages.groupBy(F.lower(F.split(title, " ")[0]).alias("slug")).agg(F.min("page_id").alias("target"))
    return links.join(slugs, "slug").select("page_id", "target").distinct()


@query("fallback_lookup", """SELECT c_custkey, coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey), (SELECT min(s_suppkey) FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey WHERE n.n_regionkey = m.n_regionkey), (SELECT min(s_suppkey) FROM supplier)) AS supplier
    FROM customer JOIN nation m ON m.n_nationkey = c_nationkey""")
def fallback_lookup(t: Tables) -> DataFrame:
    """Local first, then the neighbourhood, then anything: three joins in order of preference."""
    home = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    local = home.groupBy(F.col("n_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("a"))
    near = home.groupBy("n_regionkey").agg(F.min("s_suppkey").alias("b"))
    rows = t.customer.join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    rows = rows.join(local, "c_nationkey", "left").join(near, "n_regionkey", "left").crossJoin(F.broadcast(home.agg(F.min("s_suppkey").alias("c"))))
    return rows.select("c_custkey", F.coalesce("a", "b", "c").alias("supplier"))


@query("redundant_sections", "SELECT p_partkey AS section FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def redundant_sections(t: Tables) -> DataFrame:
    used = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(used, "p_partkey", "left_anti").select(F.col("p_partkey").alias("section"))


@query("small_section_islands", """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(l_quantity < 20 AS INT) AS small FROM lineitem),
    i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - row_number() OVER (PARTITION BY l_orderkey, small ORDER BY l_linenumber, l_partkey, l_quantity) AS g FROM m)
    SELECT l_orderkey, min(l_linenumber) AS first, count(*) AS merged FROM i WHERE small = 1 GROUP BY l_orderkey, g HAVING count(*) >= 2""")
def small_section_islands(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_quantity") < 20).alias("small"))
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")) - F.row_number().over(Window.partitionBy("l_orderkey", "small").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    runs = rows.withColumn("g", at).where("small").groupBy("l_orderkey", "g").agg(F.min("l_linenumber").alias("first"), F.count(F.lit(1)).alias("merged"))
    return runs.where("merged >= 2").select("l_orderkey", "first", "merged")


@query("progress_estimate", """WITH d AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS done FROM lineitem GROUP BY 1) SELECT l_orderkey, round(0.05 + 0.95 * done / total, 6) AS progress, round(CASE WHEN done > 0 THEN 60.0 * total / done END, 6) AS expected FROM d""")
def progress_estimate(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    return d.select("l_orderkey", F.round(F.col("done") * 0.95 / F.col("total") + 0.05, 6).alias("progress"), F.round(F.when(F.col("done") > 0, F.col("total") * 60.0 / F.col("done")), 6).alias("expected"))


@query("prioritized_changes", """SELECT o_orderkey, CASE WHEN o_orderpriority < '2' THEN 'high' WHEN o_orderpriority < '4' THEN 'medium' ELSE 'low' END AS impact FROM orders
    ORDER BY CASE WHEN o_orderpriority < '2' THEN 0 WHEN o_orderpriority < '4' THEN 1 ELSE 2 END, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey LIMIT 100""")
def prioritized_changes(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") < "2", 0).when(F.col("o_orderpriority") < "4", 1).otherwise(2)
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    names = F.array(F.lit("high"), F.lit("medium"), F.lit("low"))
    return t.orders.orderBy(rank, status, "o_orderkey").limit(100).select("o_orderkey", names[rank].alias("impact"))


@query("string_hash", "SELECT n_nationkey, list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(n_name, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, c: ((h * 31 + c) % 4294967296)) AS h FROM nation")
def string_hash(t: Tables) -> DataFrame:
    """The 31-fold rolling hash of a name, modulo 2^32."""
    chars = F.transform(F.split("n_name", ""), lambda c: F.ascii(c).cast("long"))
    return t.nation.select("n_nationkey", F.aggregate(F.filter(chars, lambda c: c > 0), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32))).alias("h"))


@query("chunked_content", "SELECT doc_id, CAST(ceil(length(text) / 3000.0) AS INT) AS chunks FROM documents WHERE length(text) > 0")
def chunked_content(t: Tables) -> DataFrame:
    """Texts cut into chunks of 3,000 characters; the chunks are counted from the rows they make."""
    rows = t.documents.where("length(text) > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.length("text"), F.lit(3000))).alias("at"), "text")
    return rows.select("doc_id", F.substring(F.col("text"), F.col("at"), F.lit(3000)).alias("chunk")).where("chunk <> ''").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("chunks"))


@query("consolidated_copies", """WITH d AS (SELECT doc_id, source, n_chars, md5(lower(text)) AS h FROM documents) SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY n_chars DESC, doc_id) AS k FROM d) WHERE k > 1""")
def consolidated_copies(t: Tables) -> DataFrame:
    """Entries that a better one of the same source replaces."""
    rows = t.documents.select("doc_id", "source", "n_chars", F.md5(F.lower("text").cast("binary")).alias("h"))
    best = rows.groupBy("source", "h").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("keep"))
    return rows.join(best, ["source", "h"]).where("doc_id <> keep").select("doc_id")


@query("consolidate_near_dupes")
def consolidate_near_dupes(t: Tables) -> DataFrame:
    """Entries merged into a longer one of the same source whose word sets have a Jaccard similarity over 0.8; greedy, so there is no SQL."""
    return code_graph.consolidated(t.documents, "doc_id", "source", "text", -F.col("n_chars"), 0.8)


@query("risk_summary", """WITH f AS (SELECT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 3 WHEN o_orderpriority = '2-HIGH' THEN 2 ELSE 1 END AS s FROM orders), r AS (SELECT o_custkey, floor(avg(s) * 100 + 0.5) / 100 AS score FROM f GROUP BY 1)
    SELECT CASE WHEN score >= 2.5 THEN 'critical' WHEN score >= 1.8 THEN 'high' WHEN score >= 1.2 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM r GROUP BY 1""")
def risk_summary(t: Tables) -> DataFrame:
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").otherwise("low")
    scored = quality.risk_score(t.orders.select("o_custkey", severity.alias("s"), F.lit(1.0).alias("c")), "o_custkey", "s", "c")
    return scored.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("rename_percentage", "SELECT round(100.0 * count(*) FILTER (c > 1) / count(*), 6) AS share FROM (SELECT md5(text) AS h, count(*) AS c FROM documents GROUP BY 1)")
def rename_percentage(t: Tables) -> DataFrame:
    copies = changes.exact_copies(t.documents, "doc_id", "text").agg(F.count(F.lit(1)).alias("c"))
    total = t.documents.select(F.md5(F.col("text").cast("binary")).alias("h")).distinct().agg(F.count(F.lit(1)).alias("n"))
    return copies.crossJoin(total).select(F.round(F.try_divide(F.col("c") * 100.0, F.col("n")), 6).alias("share"))


@query("keyword_frequency", "SELECT w AS keyword, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3)[1:5]) AS w FROM documents) GROUP BY w HAVING count(*) >= 5")
def keyword_frequency(t: Tables) -> DataFrame:
    rows = t.documents.select(F.explode(tx.keywords(F.col("text"), ("",))).alias("keyword"))
    return rows.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query("user_defined_aggregates", """SELECT l_suppkey, round(var_pop(l_quantity), 6) AS spread, round(exp(avg(ln(l_extendedprice))), 4) AS middle,
    array_to_string(list_slice(list_reverse_sort(list_distinct(list(l_orderkey))), 1, 3), ',') AS latest FROM lineitem GROUP BY l_suppkey""")
def user_defined_aggregates(t: Tables) -> DataFrame:
    """Three aggregates that are defined by how their states merge, for each supplier."""
    found = aggregates.aggregated(t.lineitem, ["l_suppkey"], {
        "spread": aggregates.variance("l_quantity"), "middle": aggregates.geometric_mean("l_extendedprice"), "latest": aggregates.top("l_orderkey", 3),
    })
    return found.select("l_suppkey", F.round("spread", 6).alias("spread"), F.round("middle", 4).alias("middle"), F.array_join(F.transform("latest", lambda x: x.cast("string")), ",").alias("latest"))
