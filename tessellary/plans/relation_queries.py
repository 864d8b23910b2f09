"""Edges that texts state and that likeness infers, cycles as paths and depth-first flows over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decisions, graph, intents, knowledge, relations
from ..sources import code
from . import aggregate_queries, knowledge_queries  # noqa: F401 - registered before
from .registry import ORACLES, QUERIES, Tables, query

_SPACES = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_CAPTURES = " || ".join(f"list_transform(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 1), lambda x: {{'rank': {i}, 'key': lower(x)}})" for i, (_, p) in enumerate(relations.PATTERNS))


@query("stated_edges", f"""
    WITH n AS (SELECT doc_id AS id, string_split_regex(text, '{_SPACES}')[1] AS name FROM documents),
    k AS (SELECT CAST(id AS VARCHAR) AS key, id, 0 AS kind FROM n UNION ALL SELECT lower(name), id, 1 FROM n),
    m AS (SELECT key, arg_max(id, (id, kind)) AS target FROM k GROUP BY key),
    t AS (SELECT doc_id AS page, unnest({_CAPTURES} || list_transform(string_split_regex(lower(text), '{_SPACES}'), lambda x: {{'rank': {len(relations.PATTERNS)}, 'key': x}})) AS f FROM documents),
    r AS (SELECT page, target, min(f.rank) AS rank FROM t JOIN m ON m.key = t.f.key GROUP BY page, target),
    e AS (SELECT least(page, target) AS x, greatest(page, target) AS y, min({{'page': page, 'rank': rank, 'target': target}}) AS e FROM r WHERE page <> target GROUP BY ALL)
    SELECT e.page AS source, e.target AS target, list_extract(['{"', '".join(k for k, _ in relations.PATTERNS)}', 'related-to'], e.rank + 1) AS type,
           CASE WHEN e.rank < {len(relations.PATTERNS)} THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS weight FROM e""")
def stated_edges(t: Tables) -> DataFrame:
    """Each document is a node named by its first word; documents that name others are joined."""
    nodes = t.documents.select(F.col("doc_id").alias("id"), F.get(F.split("text", relations.SPACES), F.lit(0)).alias("name"), F.col("doc_id").alias("page"))
    return relations.stated_edges(nodes, t.documents.select(F.col("doc_id").alias("page"), F.col("text").alias("content")))


_KINDS = ("class", "interface", "function", "pattern", "concept")
_PARTS = """n AS (SELECT p_partkey AS id, list_extract(['class', 'interface', 'function', 'pattern', 'concept'], CAST(p_size % 5 AS INT) + 1) AS type, p_name AS name,
    list_distinct(list_transform([p_brand, p_type, string_split(p_name, ' ')[2]], lambda v: lower(v))) AS tags, p_brand AS page, p_size % 7 AS file FROM part WHERE p_retailprice < 930)"""
_RELATIONS = ", ".join(f"({i}, '{a}', '{b}', '{kind}', {w}::DOUBLE)" for i, (a, b, kind, w) in enumerate(relations.TYPED))


@query("inferred_by_likeness", f"""
    WITH {_PARTS}, r(rel, f, t, kind, w) AS (VALUES {_RELATIONS}),
    p AS (SELECT a.id AS a, b.id AS b, rel, kind, w, len(list_intersect(a.tags, b.tags))::DOUBLE / len(list_distinct(a.tags || b.tags)) * 0.4::DOUBLE
                 + CASE WHEN a.page = b.page THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN a.file = b.file THEN 0.2::DOUBLE ELSE 0 END
                 + CASE WHEN contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)) THEN 0.1::DOUBLE ELSE 0 END AS alike
          FROM n a JOIN r ON a.type = f JOIN n b ON b.type = t AND a.id <> b.id),
    b AS (SELECT min({{'rel': rel, 'a': a, 'b': b, 'kind': kind, 'weight': least(1.0, alike) * w}}) AS e FROM p WHERE alike > 0.3 AND NOT (least(a, b) % 10 = 0 AND greatest(a, b) = least(a, b) + 1)
          GROUP BY least(a, b), greatest(a, b))
    SELECT e.a AS source, e.b AS target, e.kind AS type, round(e.weight, 6) AS weight FROM b""")
def inferred_by_likeness(t: Tables) -> DataFrame:
    """Parts under 930 as nodes; a part and the next one are known to be joined where the first's key ends in 0."""
    parts = t.part.where("p_retailprice < 930")
    tags = F.array("p_brand", "p_type", F.get(F.split("p_name", " "), F.lit(1)))
    kind = F.get(F.array(*map(F.lit, _KINDS)), F.col("p_size") % 5)
    nodes = parts.select(F.col("p_partkey").alias("id"), kind.alias("type"), F.col("p_name").alias("name"), tags.alias("tags"), F.col("p_brand").alias("page"), (F.col("p_size") % 7).alias("file"))
    known = parts.where("p_partkey % 10 = 0").select((F.col("p_partkey") + 1).alias("source"), F.col("p_partkey").alias("target"))
    return relations.inferred_by_likeness(nodes, known, digits=6)


@query("inferred_by_vectors", """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE score > 0.3),
    p AS (SELECT least(a, b) AS x, greatest(a, b) AS y, min({'a': a, 'b': b, 'score': score}) AS e FROM k WHERE r <= 5 GROUP BY ALL)
    SELECT e.a AS source, e.b AS target, 'related-to' AS type, round(e.score * 0.5, 6) AS weight FROM p""")
def inferred_by_vectors(t: Tables) -> DataFrame:
    none = t.embeddings.where("false").select(F.col("vec_id").alias("source"), F.col("vec_id").alias("target"))
    found = relations.inferred_by_vectors(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), none, least=0.3)
    return found.withColumn("weight", F.round("weight", 6))


_MESSAGES = """m AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN 'feat(users): add ' || props WHEN event_type = 'error' THEN 'Fix(core): redesign ' || user_id WHEN event_type = 'view' THEN 'We replaced ' || user_id ELSE event_type || ': ' || user_id END
    || chr(10) || chr(10) || 'About ' || user_id || chr(10) || chr(10) || CASE WHEN value > 50 THEN 'Reason: ' ELSE 'Note: ' END || value || chr(10) AS m FROM events)"""


@query("commit_decisions", f"""WITH {_MESSAGES}, p AS (SELECT event_id, trim(string_split(m, chr(10))[1]) AS first, m FROM m),
    c AS (SELECT *, regexp_extract(first, '{{0}}', 1) AS kind, replace(replace(regexp_extract(first, '{{0}}', 2), '(', ''), ')', '') AS scope, regexp_extract(first, '{{0}}', 3) AS subject,
                 coalesce(list_extract(list_filter(string_split(m, chr(10) || chr(10)), lambda x: regexp_matches(x, '(?i)^(why|reason|context|background)')), 1), '') AS why FROM p),
    k AS (SELECT *, CASE WHEN kind <> '' THEN subject ELSE first END AS decision, trim(regexp_replace(rtrim(why, chr(10)), '(?i)^(why|reason|context|background):?\\s*', '')) AS context FROM c
          WHERE CASE WHEN kind <> '' THEN kind IN ('feat', 'refactor') OR regexp_matches(subject, '(?i)architect|design|decision')
                ELSE regexp_matches(first, '(?i){"|".join(decisions.WORDS)}') END)
    SELECT event_id, CASE WHEN scope <> '' THEN '[' || scope || '] ' || subject ELSE decision END AS title, decision, context,
           round(0.6 + CASE WHEN length(CASE WHEN scope <> '' THEN '[' || scope || '] ' || subject ELSE decision END) > 10 THEN 0.1 ELSE 0 END + CASE WHEN length(context) > 10 THEN 0.15 ELSE 0 END, 6)::DOUBLE AS confidence
    FROM k""".replace("{0}", decisions.CONVENTIONAL))
def commit_decisions(t: Tables) -> DataFrame:
    """Decisions in messages that events are written up as."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    first = F.when(kind == "signup", F.concat(F.lit("feat(users): add "), "props")).when(kind == "error", F.concat(F.lit("Fix(core): redesign "), user)).when(kind == "view", F.concat(F.lit("We replaced "), user)).otherwise(F.concat(kind, F.lit(": "), user))
    label = F.when(F.col("value") > 50, "Reason: ").otherwise("Note: ")
    message = F.concat(first, F.lit("\n\nAbout "), user, F.lit("\n\n"), label, F.col("value").cast("string"), F.lit("\n"))
    return decisions.from_commits(t.events.select("event_id", message.alias("m")), "event_id", "m").drop("topics")


@query("impact_chains", """
    WITH d AS (SELECT c_custkey AS root, CASE WHEN c_acctbal < -900 THEN 'high' WHEN c_acctbal < 2000 THEN 'medium' ELSE 'low' END AS level FROM customer),
    i AS (SELECT o_custkey AS root, CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_totalprice > 200000 THEN 'medium' ELSE 'low' END AS level FROM orders),
    a AS (SELECT root, level FROM d WHERE root IN (SELECT root FROM i) UNION ALL SELECT root, level FROM i WHERE root IN (SELECT root FROM d))
    SELECT root, CAST(count(*) AS INT) AS length, CASE WHEN count(*) FILTER (level = 'high') > 0 THEN 'high' WHEN count(*) FILTER (level = 'medium') > 1 THEN 'medium' ELSE 'low' END AS severity FROM a GROUP BY root""")
def impact_chains(t: Tables) -> DataFrame:
    """Customers as direct impacts and their orders as indirect ones."""
    level = lambda c, high, medium: F.when(high, "high").when(medium, "medium").otherwise("low").alias("level")
    balance, price = F.col("c_acctbal"), F.col("o_totalprice")
    direct = t.customer.select(F.col("c_custkey").alias("path"), level("c", balance < -900, balance < 2000))
    indirect = t.orders.select(F.col("o_orderkey").alias("path"), level("o", price > 400000, price > 200000), F.array("o_custkey").alias("affected_by"))
    return graph.impact_chains(direct, indirect).select("root", "length", "severity")


@query("script_declarations", """
    WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS script, generate_subscripts(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), 1) AS n FROM pages),
    d AS (SELECT page_id, n, unnest(regexp_extract_all(regexp_replace(script, '"[^"]*"', '""', 'g'), '\\b(var|let|const|function|class)\\s+[A-Za-z_$][\\w$]*')) AS d FROM s)
    SELECT page_id, string_split(d, ' ')[2] AS name, CASE string_split(d, ' ')[1] WHEN 'const' THEN 'constant' WHEN 'var' THEN 'variable' WHEN 'let' THEN 'variable' ELSE string_split(d, ' ')[1] END AS kind FROM d""")
def script_declarations(t: Tables) -> DataFrame:
    """What the scripts of pages declare at their top level; strings may hold tags and quotes."""
    scripts = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("n", "content"))
    files = scripts.select(F.concat_ws(":", F.col("page_id").cast("string"), F.col("n").cast("string")).alias("path"), F.lit("typescript").alias("language"), "content")
    return code.symbols(files).select(F.substring_index("path", ":", 1).cast("long").alias("page_id"), "name", "kind")


_LAYER = "CASE " + " ".join(f"WHEN regexp_matches(name, '(?i){p}') OR regexp_matches(html, '(?i){p}') THEN '{of}'" for p, of in intents.LAYERS) + " ELSE 'unknown' END"
_DESIGNS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '(?i){p}') THEN '{n}' END" for p, n in intents.PATTERNS) + "], lambda x: x IS NOT NULL)"


@query("page_intents", f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, list_extract(string_split(url, '/'), -1) AS name FROM pages),
    c AS (SELECT *, coalesce(list_extract(regexp_extract_all(html, '{intents.BLOCK}') || regexp_extract_all(html, '{intents.LINE}'), 1), '') AS comment,
          lower(array_to_string(list_filter(string_split_regex(regexp_replace(name, '\\.[^.]+$', ''), '[._-]'), lambda x: lower(x) NOT IN ('{"', '".join(intents.PLAIN)}')), ' ')) AS made FROM p),
    i AS (SELECT page_id, coalesce(nullif(trim(regexp_extract(comment, '{intents.PURPOSE}', 1)), ''), nullif(made, ''), 'unknown') AS intent, {_LAYER} AS layer, {_DESIGNS} AS d FROM c)
    SELECT page_id, intent, layer, array_to_string(d, ',') AS patterns, round(0.3 + CASE WHEN intent <> 'unknown' THEN 0.2 ELSE 0 END + CASE WHEN len(d) > 0 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS confidence FROM i""")
def page_intents(t: Tables) -> DataFrame:
    """What pages are for, by the rules for source files: their address names them, their markup is the text."""
    files = t.pages.select(F.concat_ws("/", F.col("page_id").cast("string"), F.substring_index("url", "/", -1)).alias("path"), F.col("html").alias("content"))
    found = intents.intents(files)
    return found.select(F.substring_index("path", "/", 1).cast("long").alias("page_id"), "intent", "layer", F.array_join("patterns", ",").alias("patterns"), "confidence")


@query("knowledge_nodes", f"""SELECT 'concept' AS type, name, importance::DOUBLE AS importance FROM ({ORACLES["concepts"]})
    UNION ALL SELECT 'pattern', pattern, importance::DOUBLE FROM ({ORACLES["pattern_nodes"]})""")
def knowledge_nodes(t: Tables) -> DataFrame:
    """Concepts and patterns of parts as nodes of one graph."""
    tables = {"concept": QUERIES["concepts"](t.spark, t.sf_dir), "pattern": QUERIES["pattern_nodes"](t.spark, t.sf_dir)}
    return knowledge.union_nodes(tables, {"concept": "name", "pattern": "pattern"})
