"""Sections, knowledge nodes, reviews, conflicts and commit bodies over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import commits, knowledge
from .registry import Tables, query

_WORDS = {"cold": ("cold", "frozen"), "tools": ("widget", "tool", "gadget"), "warm": ("warm", "hot", "red")}


@query("section_slices", """
    WITH c AS (SELECT c_custkey, unnest(['# ' || c_name, 'Segment ' || c_mktsegment, '', '## Home  ', 'Nation ' || c_nationkey, '#no heading', '### Money', ' ' || CAST(c_acctbal > 0 AS VARCHAR)]) AS line,
                      unnest(range(8)) AS pos FROM customer),
    h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6} .') THEN 1 ELSE 0 END) OVER (PARTITION BY c_custkey ORDER BY pos) - 1 AS section FROM c)
    SELECT c_custkey, CAST(section AS INT) AS "order", CAST(length(regexp_extract(arg_min(line, pos), '^(#+) ', 1)) AS INT) AS level, trim(regexp_replace(arg_min(line, pos), '^#+ ', '')) AS title,
           regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS content FROM h GROUP BY c_custkey, section""")
def section_slices(t: Tables) -> DataFrame:
    lines = [F.concat(F.lit("# "), "c_name"), F.concat(F.lit("Segment "), "c_mktsegment"), F.lit(""), F.lit("## Home  "), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")), F.lit("#no heading"), F.lit("### Money")]
    content = F.concat_ws("\n", *lines, F.concat(F.lit(" "), (F.col("c_acctbal") > 0).cast("string")))
    return knowledge.sections(t.customer.select("c_custkey", content.alias("content")), "c_custkey", "content")


@query("term_positions", """SELECT p_partkey, array_to_string(list_filter(list_transform(range(length(p_name)), lambda i: CASE WHEN substr(lower(p_name), i + 1, 1) = 'd' THEN i END), lambda x: x IS NOT NULL), ',') AS positions FROM part""")
def term_positions(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(F.transform(knowledge.term_positions(F.col("p_name"), "D"), lambda x: x.cast("string")), ",").alias("positions"))


_HITS = "WITH h AS (" + " UNION ALL ".join(
    "SELECT p_partkey, p_brand, '" + p + "' AS pattern, CAST(" + " + ".join(f"len(regexp_extract_all(lower(p_name || ' ' || p_name || ' ' || p_type), '\\b{w}\\b'))" for w in ws) + " AS INT) AS hits FROM part" for p, ws in _WORDS.items()
) + "), f AS (SELECT * FROM h WHERE hits >= 2)"


def _found(t: Tables) -> DataFrame:
    pages = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_name", "p_type").alias("content"))
    return knowledge.patterns(pages, "p_partkey", "content", _WORDS)


@query("patterns_in_pages", f"{_HITS} SELECT p_partkey, pattern, hits FROM f")
def patterns_in_pages(t: Tables) -> DataFrame:
    return _found(t)


@query("pattern_nodes", f"{_HITS} SELECT pattern, count(DISTINCT p_partkey) AS pages, least(1.0, round(count(DISTINCT p_partkey) * 0.3, 6)) AS importance FROM f GROUP BY pattern")
def pattern_nodes(t: Tables) -> DataFrame:
    return knowledge.pattern_nodes(_found(t), "p_partkey")


@query("reading_minutes", """SELECT p_partkey, CAST(floor(15 * CASE p_size % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 2 WHEN 5 THEN 1.5 WHEN 6 THEN 2 ELSE 1 END + p_size / 50.0 * 5 + 0.5) AS INT) AS minutes FROM part""")
def reading_minutes(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, [*knowledge.MINUTES, "other"])), F.col("p_size") % 8 + 1)
    return t.part.select("p_partkey", knowledge.reading_minutes(kind, F.col("p_size") / 50.0).alias("minutes"))


@query("review_scores", """WITH r AS (SELECT event_id, event_id % 4 AS k, CAST(floor(value) AS BIGINT) % 11 AS v, event_type FROM events)
    SELECT event_id, CAST(CASE WHEN k IN (0, 1) THEN v WHEN k = 2 THEN CASE WHEN event_type = 'error' THEN 7 ELSE 8 END ELSE CASE WHEN event_type = 'error' THEN 6 ELSE 7 END END AS INT) AS score FROM r""")
def review_scores(t: Tables) -> DataFrame:
    v = (F.floor("value") % 11).cast("string")
    failed = F.col("event_type") == "error"
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("评分：  "), v)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("about "), v, F.lit(" / 10 points")))
        .when(F.col("event_id") % 4 == 2, F.when(failed, "优秀, 问题").otherwise("内容清晰")).otherwise(F.when(failed, "错误 and 模糊").otherwise("nothing"))
    )
    return t.events.select("event_id", knowledge.review_score(text).alias("score"))


@query("conflict_resolutions", """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'binary' ELSE 'content' END AS kind, o_orderkey % 5 AS ours, CASE WHEN o_orderkey % 7 < 3 THEN o_orderkey % 5 ELSE o_custkey % 5 END AS theirs,
        o_custkey % 10 AS a, o_orderkey % 13 AS b, o_orderstatus = 'F' AS apart FROM orders)
    SELECT o_orderkey, CASE WHEN kind = 'binary' THEN 'manual' WHEN ours > theirs THEN 'keep-local' WHEN theirs > ours THEN 'keep-remote' WHEN b > a * 1.5 THEN 'keep-remote' WHEN a > b * 1.5 THEN 'keep-local'
        WHEN apart THEN 'merge' ELSE 'manual' END AS resolution FROM c""")
def conflict_resolutions(t: Tables) -> DataFrame:
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(key % 11 == 0, "binary").otherwise("content")
    theirs = F.when(key % 7 < 3, key % 5).otherwise(other % 5)
    return t.orders.select("o_orderkey", knowledge.resolution(kind, key % 5, theirs, other % 10, key % 13, F.col("o_orderstatus") == "F").alias("resolution"))


@query("invalidated_entries", "SELECT event_type AS type, count(*) FILTER (event_type IN ('error', 'click') AND user_id % 2 = 0) AS deleted, count(*) AS entries FROM events GROUP BY 1")
def invalidated_entries(t: Tables) -> DataFrame:
    entries = t.events.select(F.col("event_type").alias("type"), F.array(F.concat(F.lit("u"), (F.col("user_id") % 2).cast("string")), F.lit("all")).alias("tags"))
    hit = knowledge.invalidated(entries, types=["error", "click"], tags=["u0", "none"])
    return entries.groupBy("type").agg(F.count_if(hit).alias("deleted"), F.count(F.lit(1)).alias("entries"))


@query("invalidated_keys", "SELECT count(*) FILTER (regexp_matches(url, '[02468]$')) AS deleted, count(*) FILTER (NOT regexp_matches(url, '[02468]$')) AS kept FROM pages WHERE url IS NOT NULL")
def invalidated_keys(t: Tables) -> DataFrame:
    hit = F.col("url").rlike("[02468]$")
    return t.pages.agg(F.count_if(hit).alias("deleted"), F.count_if(~hit).alias("kept"))


@query("merged_sections", """WITH r AS (SELECT p_brand, p_partkey AS pos, string_split(p_name, ' ') AS tags, p_size AS priority, p_partkey % 6 AS level, CASE WHEN p_size % 40 = 7 THEN NULL ELSE p_type END AS content FROM part),
    g AS (SELECT p_brand, unnest(tags) AS tag, pos FROM r), o AS (SELECT p_brand, tag, min(pos) AS pos, min_by(list_position(tags, tag), pos) AS i FROM (SELECT g.*, r.tags FROM g JOIN r USING (p_brand, pos)) GROUP BY 1, 2)
    SELECT p_brand, (SELECT string_agg(tag, ',' ORDER BY o.pos, o.i) FROM o WHERE o.p_brand = r.p_brand) AS tags, min(priority) AS priority, CAST(min(level) AS INT) AS level,
           CASE WHEN bool_and(content IS NOT NULL AND content <> '') THEN md5(string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos)) END AS content FROM r GROUP BY p_brand""")
def merged_sections(t: Tables) -> DataFrame:
    rows = t.part.select(
        "p_brand", F.col("p_partkey").alias("at"), F.split("p_name", " ").alias("tags"), F.col("p_size").alias("priority"), (F.col("p_partkey") % 6).cast("int").alias("level"),
        F.when(F.col("p_size") % 40 != 7, F.col("p_type")).alias("content"),
    )
    return knowledge.merged_sections(rows, "p_brand").withColumn("tags", F.array_join("tags", ",")).withColumn("content", F.md5("content"))


@query("linked_both_ways", "WITH l AS (SELECT o_custkey AS a, o_orderkey % 50 AS b FROM orders) SELECT DISTINCT id, other FROM (SELECT a AS id, b AS other FROM l UNION ALL SELECT b, a FROM l) WHERE id <> other")
def linked_both_ways(t: Tables) -> DataFrame:
    return knowledge.linked(t.orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 50).alias("b")))


_NODES = "n AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN 'Supplier' ELSE s_name END AS name, ['T' || (s_suppkey % 4), 't' || s_nationkey] AS tags, s_nationkey AS page, CASE WHEN s_acctbal > 0 THEN s_nationkey % 3 END AS file FROM supplier)"


@query("similar_nodes", f"""WITH {_NODES}, p AS (SELECT a.id AS a, b.id AS b, lower(a.name) AS x, lower(b.name) AS y, len(list_intersect(list_distinct(list_transform(a.tags, lambda v: lower(v))), list_distinct(list_transform(b.tags, lambda v: lower(v))))) AS i,
        len(list_distinct(list_transform(list_concat(a.tags, b.tags), lambda v: lower(v)))) AS u, a.page = b.page AS s, coalesce(a.file = b.file, false) AS f FROM n a JOIN n b ON a.id < b.id)
    SELECT a, b, similarity FROM (SELECT a, b, round(0.4 * i / u + CASE WHEN s THEN 0.3 ELSE 0 END + CASE WHEN f THEN 0.2 ELSE 0 END + CASE WHEN contains(x, y) OR contains(y, x) THEN 0.1 ELSE 0 END, 6) AS similarity FROM p) WHERE similarity >= 0.5""")
def similar_nodes(t: Tables) -> DataFrame:
    tags = F.array(F.concat(F.lit("T"), (F.col("s_suppkey") % 4).cast("string")), F.concat(F.lit("t"), F.col("s_nationkey").cast("string")))
    name = F.when(F.col("s_suppkey") % 9 == 0, "Supplier").otherwise(F.col("s_name"))
    nodes = t.supplier.select(F.col("s_suppkey").alias("id"), name.alias("name"), tags.alias("tags"), F.col("s_nationkey").alias("page"), F.when(F.col("s_acctbal") > 0, F.col("s_nationkey") % 3).alias("file"))
    return knowledge.similar_nodes(nodes, 0.5)


@query("json_in_text", """SELECT event_id, CASE WHEN event_id % 3 = 1 THEN NULL WHEN event_id % 3 = 2 THEN '[' || user_id || ', 2]' ELSE props END AS json FROM events""")
def json_in_text(t: Tables) -> DataFrame:
    text = (
        F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("broken {"), "event_type", F.lit("} text")))
        .when(F.col("event_id") % 3 == 2, F.concat(F.lit("a list ["), F.col("user_id").cast("string"), F.lit(", 2] follows"))).otherwise(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    )
    return t.events.select("event_id", knowledge.json_in(text).alias("json"))


@query("visibility_order", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY (p_size > 25) DESC, p_name, p_partkey) AS INT) AS place FROM part")
def visibility_order(t: Tables) -> DataFrame:
    return knowledge.ranked(t.part, ["p_brand"], [F.desc(F.col("p_size") > 25), "p_name", "p_partkey"]).select("p_partkey", "place")


@query("recommendation_order", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_size % 4, p_retailprice DESC, p_partkey) AS INT) AS place FROM part")
def recommendation_order(t: Tables) -> DataFrame:
    return knowledge.ranked(t.part, ["p_type"], [F.col("p_size") % 4, F.desc("p_retailprice"), "p_partkey"]).select("p_partkey", "place")


@query("section_order", "SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3, s_acctbal > 0, s_suppkey) AS INT) AS place FROM supplier")
def section_order(t: Tables) -> DataFrame:
    """Sections under each parent by priority, then by the order of their types."""
    return knowledge.ranked(t.supplier, ["s_nationkey"], [F.col("s_suppkey") % 3, F.col("s_acctbal") > 0, "s_suppkey"]).select("s_suppkey", "place")


@query("complexity_levels", """SELECT event_id, CASE WHEN s <= 1 THEN 'basic' WHEN s <= 3 THEN 'intermediate' ELSE 'advanced' END AS level FROM (SELECT event_id,
    (value > 10)::INT + (value > 50)::INT + (value > 100)::INT + (event_type = 'error')::INT + (user_id % 2 = 0)::INT + (length(props) > 8)::INT AS s FROM events)""")
def complexity_levels(t: Tables) -> DataFrame:
    tests = [F.col("value") > x for x in (10, 50, 100)] + [F.col("event_type") == "error", F.col("user_id") % 2 == 0, F.length("props") > 8]
    return t.events.select("event_id", knowledge.complexity(tests).alias("level"))


@query("conflicted_files", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'docs/a ' || o_custkey || '.md' ELSE '' END || CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN ',' ELSE '' END || CASE WHEN o_custkey % 2 = 0 THEN 'b.md' ELSE '' END AS files FROM orders""")
def conflicted_files(t: Tables) -> DataFrame:
    first = F.concat(F.when(F.col("o_orderstatus") == "F", "UU").otherwise(" M"), F.lit(" docs/a "), F.col("o_custkey").cast("string"), F.lit(".md"))
    second = F.concat(F.when(F.col("o_custkey") % 2 == 0, "AA").otherwise("??"), F.lit(" b.md"))
    return t.orders.select("o_orderkey", F.array_join(knowledge.conflicted(F.concat_ws("\n", first, second)), ",").alias("files"))


_KIND = "CASE event_type WHEN 'purchase' THEN 'feat' WHEN 'error' THEN 'fix' ELSE 'docs' END"


@query("changelog_summary", f"""WITH c AS (SELECT user_id, count(*) FILTER ({_KIND} = 'feat') AS f, count(*) FILTER ({_KIND} = 'fix') AS x, count(*) FILTER (value > 200) AS b FROM events GROUP BY user_id),
    p AS (SELECT user_id, concat_ws(', ', CASE WHEN f > 0 THEN f || ' new feature' || CASE WHEN f > 1 THEN 's' ELSE '' END END, CASE WHEN x > 0 THEN x || ' bug fix' || CASE WHEN x > 1 THEN 'es' ELSE '' END END,
          CASE WHEN b > 0 THEN b || ' breaking change' || CASE WHEN b > 1 THEN 's' ELSE '' END END) AS s FROM c)
    SELECT user_id, CASE WHEN s = '' THEN '' ELSE 'This release includes ' || s || '.' END AS summary FROM p""")
def changelog_summary(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "feat").when(F.col("event_type") == "error", "fix").otherwise("docs")
    rows = t.events.select("user_id", kind.alias("type"), (F.col("value") > 200).alias("breaking"))
    return commits.summary(rows, "user_id")


@query("commit_bodies", """WITH e AS (SELECT event_id, event_id % 6 AS k, user_id AS u, event_type AS t FROM events)
    SELECT event_id, CASE k WHEN 1 THEN 'A body' || chr(10) || chr(10) || 'Note: still body ' || u WHEN 3 THEN 'Why ' || t WHEN 5 THEN 'just words' END AS body,
        CASE k WHEN 2 THEN 'Closes=#' || u || '|Reviewed-by=' || t WHEN 3 THEN 'Refs=#' || u ELSE '' END AS footers, k IN (3, 4) AS breaking, CASE k WHEN 3 THEN 'the API' WHEN 4 THEN 'all of ' || t END AS note FROM e""")
def commit_bodies(t: Tables) -> DataFrame:
    k, u = F.col("event_id") % 6, F.col("user_id").cast("string")
    lines = (
        F.when(k == 1, F.concat(F.lit("\n\nA body\n\nNote: still body "), u)).when(k == 2, F.concat(F.lit("\n\nCloses: #"), u, F.lit("\n\nReviewed-by: "), "event_type", F.lit("\nlost line")))
        .when(k == 3, F.concat(F.lit("\n\nWhy "), "event_type", F.lit("\nBREAKING CHANGE: the API\nRefs: #"), u)).when(k == 4, F.concat(F.lit("\nbreaking-change: all of "), "event_type"))
        .when(k == 5, F.lit("\n\njust words\n\n")).otherwise(F.lit(""))
    )
    rows = commits.with_body(t.events.select("event_id", F.concat(F.lit("fix: x"), lines).alias("m")), "m")
    return rows.select("event_id", "body", F.array_join(F.transform("footers", lambda f: F.concat(f["key"], F.lit("="), f["value"])), "|").alias("footers"), "breaking", "note")
