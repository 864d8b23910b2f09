"""Text analytics over documents, pages and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import code_graph, commits, linediff, pages, quality, textdiff
from .registry import Tables, query


@query("token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


_NONEMPTY = "list_filter(regexp_split_to_array({0}, '{1}'), lambda w: trim(w) <> '')"
_SENT, _PARA = _NONEMPTY.format("text", "[.!?]+"), _NONEMPTY.format("text", "\\n\\n+")
_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
_READ = f"""100 - CASE WHEN len({_SENT}) > 0 AND list_sum(list_transform({_SENT}, lambda s: len(regexp_split_to_array(s, '\\s+')))) / len({_SENT}) > 25 THEN 15 ELSE 0 END
    - CASE WHEN len({_PARA}) > 0 AND list_sum(list_transform({_PARA}, lambda s: len(regexp_split_to_array(s, '\\s+')))) / len({_PARA}) > 150 THEN 10 ELSE 0 END
    - CASE WHEN len({_WORDS}) > 0 AND len(list_filter({_WORDS}, lambda w: length(w) > 10)) / len({_WORDS}) > 0.2 THEN 10 ELSE 0 END"""
_STRUCT = """100 - CASE WHEN len(m) = 0 THEN 30 ELSE 0 END - CASE WHEN coalesce(list_max(list_transform(m, lambda x: length(x))), 0) > 4 THEN 15 ELSE 0 END
    - CASE WHEN len(list_filter(range(1, len(m)), lambda i: length(m[i + 1]) - length(m[i]) > 1)) > 0 THEN 10 ELSE 0 END
    - CASE WHEN len(m) > 10 AND NOT contains(text, '## Table of Contents') AND NOT contains(text, '## Contents') THEN 5 ELSE 0 END"""
_COVER = f"""100 - CASE WHEN len({_WORDS}) < 100 THEN 40 WHEN len({_WORDS}) < 300 THEN 20 ELSE 0 END
    - CASE WHEN regexp_matches(lower(text), 'function|class|method|api|interface|type') AND NOT contains(text, '```') THEN 15 ELSE 0 END
    - CASE WHEN len(regexp_extract_all(text, '\\[[^\\]]+\\]\\([^)]+\\)')) = 0 THEN 10 ELSE 0 END"""
_SCORES = f"""q AS (SELECT doc_id, text, regexp_extract_all(text, '(?m)^(#{{1,6}}) .+$', 1) AS m FROM documents),
    s AS (SELECT doc_id, {_READ} AS readability, {_STRUCT} AS structure, {_COVER} AS coverage FROM q),
    o AS (SELECT *, CAST(floor((readability * 0.3 + structure * 0.3 + coverage * 0.4) / 1.0 + 0.5) AS INT) AS overall FROM s)"""


def scores(t: Tables) -> DataFrame:
    text = F.col("text")
    rows = t.documents.select("doc_id", quality.readability(text).alias("readability"), quality.structure(text).alias("structure"), quality.coverage(text).alias("coverage"))
    return rows.withColumn("overall", quality.weighted([(F.col("readability"), 0.3), (F.col("structure"), 0.3), (F.col("coverage"), 0.4)]))


@query("quality_score", f"WITH {_SCORES} SELECT doc_id, CAST(readability AS INT) AS readability, CAST(structure AS INT) AS structure, CAST(coverage AS INT) AS coverage, overall FROM o")
def quality_score(t: Tables) -> DataFrame:
    return scores(t)


_GRADE = "CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' WHEN overall >= 60 THEN 'D' ELSE 'F' END"


@query("quality_grades", f"WITH {_SCORES} SELECT {_GRADE} AS grade, count(*) AS n, round(avg(overall), 6) AS mean FROM o GROUP BY 1")
def quality_grades(t: Tables) -> DataFrame:
    return scores(t).groupBy(quality.grade(F.col("overall")).alias("grade")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overall"), 6).alias("mean"))


_RULES = [("api", "api", 90, "http", 0.8), ("api", "api", 90, "request", 0.7), ("guide", "guide", 80, "how", 0.9), ("guide", "guide", 80, "tion", 0.4),
          ("decision", "decision", 70, "because", 0.6), ("decision", "decision", 70, "nicht", 0.5), ("module", "module", 85, "que", 0.45)]
_RULES_SQL = "rules(rule, category, priority, pattern, weight) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}, '{d}', CAST({e} AS DOUBLE))" for a, b, c, d, e in _RULES) + ")"


@query("classify_rules", f"""WITH {_RULES_SQL}, n AS (SELECT rule, count(*) AS conditions FROM rules GROUP BY rule),
    m AS (SELECT doc_id, r.rule, category, priority, sum(weight) / max(conditions) AS score FROM documents JOIN rules r ON contains(lower(text), pattern) JOIN n ON n.rule = r.rule GROUP BY 1, 2, 3, 4),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, priority DESC, rule) AS k FROM m)
    SELECT d.doc_id, coalesce(category, 'unknown') AS category, round(coalesce(score, 0), 6) AS score FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND k = 1""")
def classify_rules(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame(_RULES, "rule string, category string, priority int, pattern string, weight double")
    return quality.classify(t.documents, rules, "doc_id", "text").withColumn("score", F.round("score", 6))


@query("classify_heuristic", """SELECT page_id, CASE WHEN contains(title, 'overview') OR contains(title, 'summary') OR contains(title, 'readme') THEN 'overview' WHEN contains(title, 'architecture') OR contains(title, 'design') OR contains(title, 'system') THEN 'architecture'
    WHEN contains(html, 'api') OR contains(html, 'endpoint') OR contains(html, 'request') OR contains(html, 'response') THEN 'api' ELSE 'unknown' END AS category
    FROM (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, lower(html) AS html FROM pages)""")
def classify_heuristic(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.lower("html").alias("html"))
    has = lambda c, *words: F.col(c).rlike("|".join(words))
    kind = F.when(has("title", "overview", "summary", "readme"), "overview").when(has("title", "architecture", "design", "system"), "architecture")
    return rows.select("page_id", kind.when(has("html", "api", "endpoint", "request", "response"), "api").otherwise("unknown").alias("category"))


@query("html_links", "SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages)")
def html_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("link"))


@query("html_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages")
def html_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"))


@query("page_backlinks", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"/([^\"]*)\"', 1)) AS slug FROM pages)
    SELECT slug, count(DISTINCT page_id) AS pages FROM l GROUP BY slug HAVING count(DISTINCT page_id) > 1""")
def page_backlinks(t: Tables) -> DataFrame:
    links = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("slug"))
    return links.distinct().groupBy("slug").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")


@query("slugify", "SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM pages")
def slugify(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query("camel_split", "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(p_type || p_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[\\s_-]+'), lambda w: w <> ''), '|') AS words FROM part")
def camel_split(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(tx.split_camel(F.concat("p_type", "p_name")), "|").alias("words"))


@query("naming_pattern", """SELECT style, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(x, '[A-Z][a-zA-Z]*') THEN 'PascalCase' WHEN regexp_full_match(x, '[a-z][a-zA-Z]*') THEN 'camelCase' WHEN regexp_full_match(x, '[a-z]+(_[a-z]+)*') THEN 'snake_case'
    WHEN regexp_full_match(x, '[A-Z]+(_[A-Z]+)*') THEN 'UPPER_SNAKE_CASE' WHEN regexp_full_match(x, '[a-z]+(-[a-z]+)*') THEN 'kebab-case' ELSE 'unknown' END AS style
    FROM (SELECT unnest(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) AS x FROM part)) GROUP BY style""")
def naming_pattern(t: Tables) -> DataFrame:
    words = t.part.select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")).alias("x"))
    return words.groupBy(tx.naming_pattern(F.col("x")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query("keypoints", "SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s)), lambda s: s <> '' AND length(s) >= 10 AND regexp_matches(lower(s), 'the|que|und|los'))[1:10] AS points FROM documents")
def keypoints(t: Tables) -> DataFrame:
    found = F.filter(tx.sentences(F.col("text"), 10), lambda s: F.lower(s).rlike("the|que|und|los"))
    return t.documents.select("doc_id", F.slice(found, 1, 10).alias("points"))


@query("heuristic_summary", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(string_split(text, chr(10))[1], ' '), lambda w: w <> '') AS w, len(list_filter(regexp_split_to_array(text, ' '), lambda w: w <> '')) AS n FROM documents)
    SELECT doc_id, array_to_string(w[1:50], ' ') || CASE WHEN len(w) > 50 THEN '...' ELSE '' END AS summary, CAST(ceil(n / 200.0) AS INT) AS minutes FROM w""")
def heuristic_summary(t: Tables) -> DataFrame:
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    rows = t.documents.select("doc_id", words(F.split("text", "\n")[0]).alias("w"), F.size(words(F.col("text"))).alias("n"))
    summary = F.concat(F.array_join(F.slice("w", 1, 50), " "), F.when(F.size("w") > 50, "...").otherwise(""))
    return rows.select("doc_id", summary.alias("summary"), F.ceil(F.col("n") / 200).cast("int").alias("minutes"))


@query("first_words", "SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3 AND w NOT IN ('that', 'with', 'this', 'from', 'nicht', 'dans', 'pour'))[1:5] AS keywords FROM documents")
def first_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.keywords(F.col("text"), ("that", "with", "this", "from", "nicht", "dans", "pour")).alias("keywords"))


_COMMITS = """c AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'feat(users)!: add user ' || user_id || ' #' || event_id WHEN 'purchase' THEN 'feature(shop): sell PROJ-' || event_id WHEN 'error' THEN 'fix: repair ' || user_id || ' closes #' || user_id
    WHEN 'view' THEN 'wibble: show ' || user_id ELSE 'merge branch ' || user_id END AS m FROM events),
    p AS (SELECT event_id, CASE lower(regexp_extract(m, '^(\\w+)(\\([^)]+\\))?(!)?:', 1)) WHEN 'feature' THEN 'feat' WHEN 'feat' THEN 'feat' WHEN 'fix' THEN 'fix' ELSE 'chore' END AS type,
      nullif(regexp_extract(m, '^\\w+\\(([^)]+)\\)!?:', 1), '') AS scope, CASE WHEN regexp_matches(m, '^\\w+(\\([^)]+\\))?!?:\\s*.+$') THEN trim(regexp_extract(m, '^\\w+(\\([^)]+\\))?!?:\\s*(.+)$', 2)) ELSE m END AS description,
      regexp_matches(m, '^\\w+(\\([^)]+\\))?!:') AS breaking, array_to_string(list_concat(regexp_extract_all(m, '#\\d+'), regexp_extract_all(m, '[A-Z]+-\\d+')), ',') AS issues FROM c)"""


def event_commits(t: Tables) -> DataFrame:
    kind, user, no = F.col("event_type"), F.col("user_id"), F.col("event_id")
    message = (
        F.when(kind == "signup", F.concat(F.lit("feat(users)!: add user "), user, F.lit(" #"), no)).when(kind == "purchase", F.concat(F.lit("feature(shop): sell PROJ-"), no))
        .when(kind == "error", F.concat(F.lit("fix: repair "), user, F.lit(" closes #"), user)).when(kind == "view", F.concat(F.lit("wibble: show "), user))
        .otherwise(F.concat(F.lit("merge branch "), user))
    )
    return commits.parsed(t.events.select("event_id", message.alias("m")), "m")


@query("commit_parse", f"WITH {_COMMITS} SELECT * FROM p")
def commit_parse(t: Tables) -> DataFrame:
    return event_commits(t).select("event_id", "type", "scope", "description", "breaking", F.array_join("issues", ",").alias("issues"))


@query("changelog_sections", f"WITH {_COMMITS} SELECT type, breaking, count(*) AS entries, min(event_id) AS first FROM p WHERE type <> 'chore' AND NOT regexp_matches(description, '(?i)^(merge|bump|release)') GROUP BY 1, 2")
def changelog_sections(t: Tables) -> DataFrame:
    shown = event_commits(t).where((F.col("type") != "chore") & ~F.col("description").rlike("(?i)^(merge|bump|release)"))
    return shown.groupBy("type", "breaking").agg(F.count(F.lit(1)).alias("entries"), F.min("event_id").alias("first"))


@query("version_bump", f"WITH {_COMMITS} SELECT CASE WHEN bool_or(breaking) THEN 'major' WHEN bool_or(type = 'feat') THEN 'minor' ELSE 'patch' END AS bump FROM p")
def version_bump(t: Tables) -> DataFrame:
    return commits.next_version(event_commits(t))


@query("version_numbers", "SELECT p_partkey, CAST(p_size * 10000 + (p_partkey % 100) * 100 + length(p_brand) AS BIGINT) AS number FROM part")
def version_numbers(t: Tables) -> DataFrame:
    version = F.concat_ws(".", F.col("p_size"), F.col("p_partkey") % 100, F.length("p_brand"))
    return t.part.select("p_partkey", commits.version_number(version).alias("number"))


@query("risk_score", """WITH f AS (SELECT user_id, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END AS s, least(value, 100) / 100 AS c FROM events),
    r AS (SELECT user_id, floor(sum(s * c) / sum(c) * 100 + 0.5) / 100 AS score FROM f GROUP BY user_id)
    SELECT user_id, round(score, 6) AS score, CASE WHEN score >= 2.5 THEN 'critical' WHEN score >= 1.8 THEN 'high' WHEN score >= 1.2 THEN 'medium' ELSE 'low' END AS level FROM r""")
def risk_score(t: Tables) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    factors = t.events.select("user_id", severity.alias("severity"), (F.least("value", F.lit(100.0)) / 100).alias("confidence"))
    return quality.risk_score(factors, "user_id", "severity", "confidence").withColumn("score", F.round("score", 6))


@query("word_jaccard_neighbors", """
    WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS s, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM documents)
    SELECT a.doc_id, b.doc_id AS other, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM w a JOIN w b ON a.nxt = b.doc_id""")
def word_jaccard_neighbors(t: Tables) -> DataFrame:
    sets = t.documents.select("doc_id", "source", tx.word_set(F.col("text")).alias("s"))
    w = Window.partitionBy("source").orderBy("doc_id")
    rows = sets.withColumn("other", F.lead("doc_id").over(w)).withColumn("os", F.lead("s").over(w)).where("other is not null")
    return rows.select("doc_id", "other", F.round(tx.jaccard(F.col("s"), F.col("os")), 6).alias("jaccard"))


@query("word_jaccard_pairs", """
    WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS word FROM documents),
    n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM w x JOIN w y ON x.word = y.word AND x.doc_id < y.doc_id GROUP BY 1, 2)
    SELECT a, b, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared / (x.n + y.n - shared) > 0.3""")
def word_jaccard_pairs(t: Tables) -> DataFrame:
    """All pairs of documents whose word sets have a Jaccard similarity over 0.3."""
    found = code_graph.similar_items(t.documents, "doc_id", "text", 0.3)
    return found.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def neighbours(t: Tables) -> DataFrame:
    """(doc_id, text, after): each document with the text of the next one of its source; only ids go through the window."""
    following = F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    ids = t.documents.select("doc_id", following.alias("next"))
    texts = t.documents.select("doc_id", "text")
    return ids.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("next"), F.col("text").alias("after")), "next", "left").drop("next")


@query("text_diff_stats")
def text_diff_stats(t: Tables) -> DataFrame:
    """Line diff of each document and the next one of its source."""
    return textdiff.diff_stats(neighbours(t), "doc_id", "text", "after")


@query("shortest_edit_counts", """
    WITH RECURSIVE p AS (SELECT doc_id, text AS a, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents),
    l AS (SELECT doc_id, CASE WHEN coalesce(a, '') = '' THEN [] ELSE string_split(a, chr(10)) END AS x, CASE WHEN coalesce(b, '') = '' THEN [] ELSE string_split(b, chr(10)) END AS y FROM p),
    r AS (SELECT doc_id, 0 AS i, x, y, list_transform(y, lambda v: 0) AS best FROM l UNION ALL
          SELECT doc_id, i + 1, x, y, list_transform(range(len(y)), lambda j: list_max(list_transform(range(j + 1), lambda q:
                 greatest(best[q + 1], CASE WHEN y[q + 1] = x[i + 1] THEN coalesce(best[q], 0) + 1 ELSE 0 END)))) FROM r WHERE i < len(x)),
    k AS (SELECT doc_id, len(x) AS n, len(y) AS m, coalesce(list_max(best), 0) AS kept FROM r WHERE i = len(x))
    SELECT doc_id, CAST(m - kept AS BIGINT) AS additions, CAST(n - kept AS BIGINT) AS deletions,
           CASE WHEN greatest(n, m) = 0 THEN 1.0::DOUBLE ELSE kept::DOUBLE / greatest(n, m) END AS similarity FROM k""")
def shortest_edit_counts(t: Tables) -> DataFrame:
    """Lines that a shortest script adds and removes between each document and the next one of its source, and their likeness."""
    return linediff.counts(neighbours(t), "doc_id", "text", "after")


@query("markdown_export", """SELECT source, md5(string_agg('## ' || doc_id || chr(10) || CAST(n_chars AS VARCHAR), chr(10) ORDER BY doc_id)) AS page, count(*) AS sections FROM documents GROUP BY source""")
def markdown_export(t: Tables) -> DataFrame:
    section = F.struct("doc_id", F.concat(F.lit("## "), "doc_id", F.lit("\n"), "n_chars").alias("text"))
    rows = t.documents.groupBy("source").agg(F.array_sort(F.collect_list(section)).alias("s"), F.count(F.lit(1)).alias("sections"))
    return rows.select("source", F.md5(F.array_join(F.transform("s", lambda x: x["text"]), "\n").cast("binary")).alias("page"), "sections")


@query("escape_text", """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM documents""")
def escape_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.escape_xml(F.col("text")).alias("xml"))


@query("module_of_path", "SELECT page_id, coalesce(nullif(string_split(url, '/')[len(string_split(url, '/')) - 1], ''), 'root') AS module FROM pages")
def module_of_path(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.module_of(F.col("url")).alias("module"))


@query("quality_label_lift", f"WITH {_SCORES} SELECT quality, count(*) AS n, round(avg(overall), 6) AS mean FROM o JOIN labels USING (doc_id) GROUP BY quality")
def quality_label_lift(t: Tables) -> DataFrame:
    return scores(t).join(t.labels, "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overall"), 6).alias("mean"))


@query("split_texts", """
    WITH RECURSIVE d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, text, 0 AS n, CAST(0 AS BIGINT) AS low, CAST(NULL AS VARCHAR) AS part FROM d
          UNION ALL SELECT doc_id, text, n + 1, low + length(p), p FROM (
            SELECT doc_id, text, n, low, CASE WHEN last_line > 2400 AND low + 3000 < length(text) THEN substr(text, low + 1, last_line) ELSE substr(text, low + 1, 3000) END AS p FROM (
              SELECT *, length(substr(text, low + 1, 3000)) - position(chr(10) IN reverse(substr(text, low + 1, 3000))) AS last_line FROM c) WHERE low < length(text)))
    SELECT doc_id, CAST(n - 1 AS INT) AS n, md5(part) AS part FROM c WHERE n > 0 AND length(part) > 0 UNION ALL SELECT doc_id, 0, md5('') FROM d WHERE text = ''""")
def split_texts(t: Tables) -> DataFrame:
    """Documents in parts of at most 3,000 characters, cut before a line break where one is near."""
    return pages.split_texts(t.documents, "doc_id", "text", 3000).select("doc_id", "n", F.md5(F.col("part").cast("binary")).alias("part"))


@query("word_jaccard_classes", """
    WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS word FROM documents),
    n AS (SELECT doc_id, count(*) AS n, md5(string_agg(word, ' ' ORDER BY word)) AS bag FROM w GROUP BY doc_id), c AS (SELECT bag, min(doc_id) AS class FROM n GROUP BY bag),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM w x JOIN w y ON x.word = y.word AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    l AS (SELECT a, count(*) AS links FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared / (x.n + y.n - shared) > 0.3 GROUP BY a)
    SELECT d.doc_id AS id, c.class, coalesce(links, 0) AS n_links FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (bag) LEFT JOIN l ON l.a = d.doc_id""")
def word_jaccard_classes(t: Tables) -> DataFrame:
    """Each document's class of equal word sets, and how many others have a Jaccard similarity over 0.3; a row a document, however many copies there are."""
    return code_graph.similar_classes(t.documents, "doc_id", "text", 0.3)
