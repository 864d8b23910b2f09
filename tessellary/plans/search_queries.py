"""Search: keyword, vector and hybrid queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import search
from .registry import Tables, query

_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1)"
DOC_WORDS = _WORDS.format("text")
#: The first five distinct words of the first benchmark passage, in order, are the query.
QUERY_TERMS = f"""
    q0 AS (SELECT {_WORDS.format("text")} AS w FROM benchmark WHERE item_id = 0),
    q1 AS (SELECT unnest(w) AS term, generate_subscripts(w, 1) AS i FROM q0),
    terms AS (SELECT term FROM (SELECT term, min(i) AS i FROM q1 GROUP BY term) ORDER BY i LIMIT 5)"""
_TFIDF = f"""
    toks AS (SELECT doc_id AS id, unnest({DOC_WORDS}) AS term FROM documents),
    tf AS (SELECT id, term, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM terms) GROUP BY id, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    kw AS (SELECT id, sum(tf * ln((SELECT count(*) FROM documents) / df)) / (SELECT count(*) FROM terms) AS score
           FROM tf JOIN df USING (term) GROUP BY id)"""


def query_terms(t: Tables) -> list[str]:
    row = t.benchmark.where("item_id = 0").select(F.slice(F.array_distinct(tx.words(F.col("text"))), 1, 5).alias("w")).first()
    return list(row.w) if row else []


@query("tfidf_search", f"WITH {QUERY_TERMS}, {_TFIDF} SELECT id, round(score, 6) AS score FROM kw ORDER BY kw.score DESC, id LIMIT 20")
def tfidf_search(t: Tables) -> DataFrame:
    scored = search.keyword_scores(t.documents, "doc_id", "text", query_terms(t))
    return search.top_k(scored, 20).select("id", F.round("score", 6).alias("score"))


@query("postings_stats", f"""
    WITH toks AS (SELECT doc_id AS id, unnest({DOC_WORDS}) AS term FROM documents),
    p AS (SELECT term, id, count(*) AS tf FROM toks GROUP BY term, id)
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY term""")
def postings_stats(t: Tables) -> DataFrame:
    return search.postings(t.documents, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def _queries(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 100 = 0")


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_NEAR = f"""
    pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs)"""


@query("cosine_topk", f"WITH {_NEAR} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10")
def cosine_topk(t: Tables) -> DataFrame:
    return search.nearest(t.embeddings, _queries(t), 10).withColumn("score", F.round("score", 6))


@query("similar_above_threshold", f"""WITH {_NEAR.replace("% 100 = 0)", "% 100 = 0 AND " + _COS + " > 0.25)")}
    SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5""")
def similar_above_threshold(t: Tables) -> DataFrame:
    return search.nearest(t.embeddings, _queries(t), 5, 0.25).withColumn("score", F.round("score", 6))


@query("vector_centroids", """
    WITH p AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
    SELECT label, CAST(pos AS INT) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM p GROUP BY label, pos""")
def vector_centroids(t: Tables) -> DataFrame:
    return search.centroids(t.embeddings, "label", "embedding").withColumn("value", F.round("value", 6))


@query("vector_norms", """SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])), 6) AS norm,
    CAST(len(embedding) AS INT) AS dim FROM embeddings""")
def vector_norms(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(vx.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("dim"))


@query("spherical_kmeans")
def spherical_kmeans(t: Tables) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=8, seed=1, maxIter=100, distanceMeasure="cosine").fit(rows)
    return model.transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


_SEM = """sem AS (SELECT b.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
    FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0),
    sem40 AS (SELECT * FROM sem ORDER BY score DESC, id LIMIT 40), kw40 AS (SELECT * FROM kw ORDER BY score DESC, id LIMIT 40)"""


@query("hybrid_search", f"""WITH {QUERY_TERMS}, {_TFIDF}, {_SEM}
    SELECT id, round(coalesce(kw40.score, 0), 6) AS keyword_score, round(coalesce(sem40.score, 0), 6) AS semantic_score,
           round(coalesce(kw40.score, 0) * 0.4 + coalesce(sem40.score, 0) * 0.6, 6) AS score
    FROM kw40 FULL JOIN sem40 USING (id) WHERE coalesce(kw40.score, 0) * 0.4 + coalesce(sem40.score, 0) * 0.6 >= 0.1
    ORDER BY coalesce(kw40.score, 0) * 0.4 + coalesce(sem40.score, 0) * 0.6 DESC, id LIMIT 20""")
def hybrid_search(t: Tables) -> DataFrame:
    keyword = search.top_k(search.keyword_scores(t.documents, "doc_id", "text", query_terms(t)), 40)
    semantic = search.nearest(t.embeddings, t.embeddings.where("vec_id = 0"), 40).select("id", "score")
    both = search.fused(keyword, semantic, 0.4, 0.6).where("score >= 0.1")
    return search.top_k(both, 20).select("id", *(F.round(c, 6).alias(c) for c in ("keyword_score", "semantic_score", "score")))


_FILTERS = [("lang", "eq", "en"), ("source", "ne", "src0"), ("source", "in", ["src1", "src2", "src3", "src4"]), ("source", "nin", ["src4"]),
            ("n_chars", "gt", 500), ("n_chars", "lte", 5000), ("n_chars", "gte", 501), ("n_chars", "lt", 5001), ("text", "contains", "the")]


@query("search_filters", """SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source <> 'src0' AND source IN ('src1','src2','src3','src4')
    AND source NOT IN ('src4') AND n_chars > 500 AND n_chars <= 5000 AND n_chars >= 501 AND n_chars < 5001 AND contains(text, 'the')""")
def search_filters(t: Tables) -> DataFrame:
    return search.filtered(t.documents, _FILTERS).select("doc_id", "lang", "source", "n_chars")


@query("search_highlight", """SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?i)(.{0,50}tion the.{0,50})', 1), ''), nullif(regexp_extract(text, '(?i)(.{0,50}que.{0,50})', 1), ''), '') AS highlight FROM documents""")
def search_highlight(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", search.highlight(F.col("text"), ["tion the", "que"]).alias("highlight"))


@query("prefix_suggestions", f"SELECT DISTINCT term FROM (SELECT unnest({DOC_WORDS}) AS term FROM documents) WHERE starts_with(term, 'tion') AND term <> 'tion' ORDER BY term LIMIT 10")
def prefix_suggestions(t: Tables) -> DataFrame:
    return search.suggestions(t.documents, "text", "tion", 10)


@query("pattern_count_search", """SELECT doc_id, round((len(regexp_extract_all(lower(text), 'the')) + len(regexp_extract_all(lower(text), 'tion'))) / 2.0, 6) AS score
    FROM documents WHERE len(regexp_extract_all(lower(text), 'the')) + len(regexp_extract_all(lower(text), 'tion')) > 0""")
def pattern_count_search(t: Tables) -> DataFrame:
    count = sum((F.regexp_count(F.lower("text"), F.lit(p)) for p in ("the", "tion")), F.lit(0))
    return t.documents.select("doc_id", F.round(count / 2.0, 6).alias("score")).where("score > 0")


_KEYS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 3))"


@query("kb_keyword_index", f"SELECT keyword, count(*) AS pages FROM (SELECT doc_id, unnest({_KEYS}) AS keyword FROM documents) GROUP BY keyword")
def kb_keyword_index(t: Tables) -> DataFrame:
    keys = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 3))
    return t.documents.select(F.explode(keys).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("pages"))


def _holding(sections: str, word: str):  # noqa: ANN202 - a column
    return F.size(F.filter(sections, lambda x: x.contains(word)))


@query("kb_keyword_score", f"""
    WITH s AS (SELECT doc_id, {_KEYS} AS keys, string_split(text, chr(10)) AS sections FROM documents),
    q AS (SELECT unnest(['with', 'from', 'dans', 'nicht']) AS k)
    SELECT doc_id, round(sum(CASE WHEN list_contains(keys, k) THEN 1.0 ELSE 0 END + 0.5 * len(list_filter(sections, lambda x: contains(lower(x), k)))), 6) AS score
    FROM s, q GROUP BY doc_id HAVING sum(CASE WHEN list_contains(keys, k) THEN 1.0 ELSE 0 END + 0.5 * len(list_filter(sections, lambda x: contains(lower(x), k)))) > 0
    ORDER BY score DESC, doc_id LIMIT 10""")
def kb_keyword_score(t: Tables) -> DataFrame:
    keys = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 3))
    sections = F.transform(F.split("text", "\n"), F.lower)
    score = F.lit(0.0)
    for k in ("with", "from", "dans", "nicht"):
        score = score + F.array_contains("keys", k).cast("int") + _holding("sections", k) * 0.5
    docs = t.documents.select("doc_id", keys.alias("keys"), sections.alias("sections"))
    return docs.select("doc_id", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(10)


@query("kb_relevance_score", f"""
    WITH s AS (SELECT doc_id, {_KEYS} AS keys, substr(string_split(text, chr(10) || chr(10))[1], 1, 200) AS summary, string_split(text, chr(10)) AS sections FROM documents),
    q AS (SELECT unnest(['the', 'with', 'from']) AS k)
    SELECT doc_id, CAST(sum(CASE WHEN list_contains(keys, k) THEN 1 ELSE 0 END + CASE WHEN contains(lower(summary), k) THEN 2 ELSE 0 END
        + len(list_filter(sections, lambda x: contains(lower(x), k)))) AS BIGINT) AS score FROM s, q GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 5""")
def kb_relevance_score(t: Tables) -> DataFrame:
    keys = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 3))
    summary = F.lower(F.substring(F.split("text", "\n\n")[0], 1, 200))
    docs = t.documents.select("doc_id", keys.alias("keys"), summary.alias("summary"), F.transform(F.split("text", "\n"), F.lower).alias("sections"))
    score = F.lit(0)
    for k in ("the", "with", "from"):
        score = score + F.array_contains("keys", k).cast("int") + F.col("summary").contains(k).cast("int") * 2
        score = score + _holding("sections", k)
    return docs.select("doc_id", score.cast("long").alias("score")).orderBy(F.desc("score"), "doc_id").limit(5)


@query("memory_relevance", """
    WITH m AS (SELECT doc_id, least(1.0, (0.2 * (CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text), 'nicht') AS INT))
        + 0.3 * CAST(source = 'src3' AS INT) + 0.1 * CAST(lang = 'en' AS INT)) * 0.9 * 0.8) AS r FROM documents)
    SELECT doc_id, round(r, 6) AS relevance FROM m WHERE r >= 0.1""")
def memory_relevance(t: Tables) -> DataFrame:
    found = sum((F.lower("text").contains(w).cast("int") for w in ("tion", "nicht")), F.lit(0)) * 0.2
    score = (found + (F.col("source") == "src3").cast("int") * 0.3 + (F.col("lang") == "en").cast("int") * 0.1) * 0.9 * 0.8
    rows = t.documents.select("doc_id", F.least(F.lit(1.0), score).alias("r")).where("r >= 0.1")
    return rows.select("doc_id", F.round("r", 6).alias("relevance"))


@query("interaction_similarity", """
    WITH q AS (SELECT unnest(['click', 'view', 'sign']) AS w)
    SELECT event_id, CAST(sum(CASE WHEN contains(event_type, w) OR contains(w, event_type) THEN 2 ELSE 0 END + CASE WHEN event_type = w THEN 3 ELSE 0 END
        + CASE WHEN contains(props, w) THEN 1 ELSE 0 END) AS BIGINT) AS score FROM events, q GROUP BY event_id HAVING score > 0""")
def interaction_similarity(t: Tables) -> DataFrame:
    kind, score = F.col("event_type"), F.lit(0)
    for w in ("click", "view", "sign"):
        score = score + (kind.contains(w) | F.lit(w).contains(kind)).cast("int") * 2 + (kind == w).cast("int") * 3 + F.col("props").contains(w).cast("int")
    return t.events.select("event_id", score.cast("long").alias("score")).where("score > 0")


@query("context_budget_pack")
def context_budget_pack(t: Tables) -> DataFrame:
    """Greedy packing: best first, an item that doesn't fit is skipped and smaller ones may follow; one budget for each source and language."""
    scored = t.documents.select("source", "lang", "doc_id", "n_chars", tx.token_estimate(F.col("text")).alias("tokens"))
    return search.packed(scored, ["source", "lang"], [F.desc("n_chars"), F.asc("doc_id")], "doc_id", "tokens", 4000)


@query("hashed_embeddings")
def hashed_embeddings(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", vx.hashed_embedding(F.coalesce("text", F.lit("")), 16).alias("embedding"))
