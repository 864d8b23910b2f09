"""Keyword, vector and hybrid search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .best import SIDE, Best, products, unit

#: Bytes of query vectors that tasks share at once; each worker holds a copy.
SHARED = 16_000_000


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, id, tf): how often each word is in each document."""
    exploded = docs.select(F.col(doc_id).alias("id"), F.explode(tx.words(F.col(text))).alias("term"))
    return exploded.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def keyword_scores(docs: DataFrame, doc_id: str, text: str, terms: list[str]) -> DataFrame:
    """(id, score): sum of tf * ln(N / df) over the query's terms, repeated ones counting again, by the number of terms.

    Only postings of the query's terms are counted, so the shuffle holds a row for each document and term that match.
    """
    wanted = sorted(set(terms))
    hits = docs.select(F.col(doc_id).alias("id"), F.explode(F.filter(tx.words(F.col(text)), lambda w: w.isin(*wanted))).alias("term"))
    tf = hits.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row a term of the query
    times = F.create_map(*(F.lit(x) for t in wanted for x in (t, terms.count(t))))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.log(F.col("n") / F.col("df")) * times[F.col("term")]).alias("idf"))
    scored = tf.join(F.broadcast(idf), "term").groupBy("id").agg(F.sum(F.col("tf") * F.col("idf")).alias("s"))
    return scored.select("id", (F.col("s") / len(terms)).alias("score"))


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The best ``k`` rows, ties to the smaller key; tasks keep ``k`` rows each."""
    return scored.orderBy(F.desc(score), key).limit(k)


def fused(keyword: DataFrame, semantic: DataFrame, keyword_weight: float, semantic_weight: float) -> DataFrame:
    """Full outer join of two (id, score) results; a missing side counts 0."""
    k = keyword.select("id", F.col("score").alias("keyword_score"))
    s = semantic.select("id", F.col("score").alias("semantic_score"))
    both = k.join(s, "id", "full_outer").na.fill(0.0, ["keyword_score", "semantic_score"])
    return both.withColumn("score", F.col("keyword_score") * keyword_weight + F.col("semantic_score") * semantic_weight)


def predicate(field: str, op: str, value: object) -> Column:
    """One filter: eq ne in nin gt lt gte lte contains. ``nin`` with no list is false, an unknown operator true."""
    c = F.col(field)
    if op in ("in", "nin") and not isinstance(value, (list, tuple)):
        return F.lit(False)
    known = {
        "eq": lambda: c == value, "ne": lambda: c != value, "in": lambda: c.isin(*value), "nin": lambda: ~c.isin(*value),
        "gt": lambda: c > value, "lt": lambda: c < value, "gte": lambda: c >= value, "lte": lambda: c <= value,
        "contains": lambda: c.cast("string").contains(str(value)),
    }
    return F.coalesce(known[op](), F.lit(op in ("ne", "nin"))) if op in known else F.lit(True)


def filtered(rows: DataFrame, filters: list[tuple[str, str, object]]) -> DataFrame:
    """Rows that meet all filters."""
    return rows.where(reduce(lambda a, b: a & b, (predicate(*f) for f in filters), F.lit(True)))


def highlight(text: Column, terms: list[str]) -> Column:
    """The first term that occurs, with up to 50 characters of its line on either side; empty if none does."""
    found = [F.regexp_extract(text, f"(?i)(.{{0,50}}\\Q{t}\\E.{{0,50}})", 1) for t in terms]
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found), F.lit(""))


def suggestions(docs: DataFrame, text: str, prefix: str, k: int) -> DataFrame:
    """The first ``k`` distinct words, in order, that begin with the prefix and aren't it."""
    terms = docs.select(F.explode(F.filter(tx.words(F.col(text)), lambda w: w.startswith(prefix) & (w != prefix))).alias("term"))
    return terms.distinct().orderBy("term").limit(k)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, least: float = -2.0, vec_id: str = "vec_id", vec: str = "embedding", block: int = 50_000
) -> DataFrame:
    """(query_id, id, score): the ``k`` rows most alike to each query vector, itself left out, with cosine over ``least``.

    The query set is read in blocks of at most ``block`` vectors and SHARED bytes; each block meets all rows once, each task keeping
    ``k`` rows for each query and SIDE x SIDE scores at a time, so nothing near all pairs is held or shuffled. Zero and null vectors score 0.
    """
    spark = vectors.sparkSession
    given = queries.select(F.col(vec_id).alias("q"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    any_query = given.first()
    block = block if any_query is None else max(1, min(block, SHARED // max(1, 8 * len(any_query.v))))  # all are of one length
    out = None
    last = None
    while True:
        part = given if last is None else given.where(F.col("q") > last)
        part_rows = part.orderBy("q").limit(block).toArrow()
        if not part_rows.num_rows:
            break
        last = part_rows["q"][-1].as_py()
        # at length 1 once, here; a task would hold a copy of its own
        ids = part_rows["q"].to_numpy()
        shared = spark.sparkContext.broadcast((ids, unit(part_rows["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1))))

        def on_partition(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = Best(len(ids), k)
            for batch in (b.slice(low, SIDE) for b in batches for low in range(0, b.num_rows, SIDE)):
                rid = batch.column(0).to_numpy()
                x = unit(batch.column(1).flatten().to_numpy().reshape(len(rid), -1))
                for low in range(0, len(ids), SIDE):
                    score = products(q[low : low + SIDE], x)
                    score[ids[low : low + SIDE, None] == rid] = -9.0
                    best.meet(low, score, rid)
            found = best.over(ids, max(least, -2.0))
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "id", "score"])

        rows_in = vectors.select(F.col(vec_id).cast("long"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
        found = rows_in.mapInArrow(on_partition, "query_id bigint, id bigint, score double")
        out = found if out is None else out.unionByName(found)
        if part_rows.num_rows < block:
            break
    if out is None:
        return spark.createDataFrame([], "query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def centroids(vectors: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, pos, value): the mean vector of each label, one row a component."""
    parts = vectors.select(F.col(label).alias("label"), F.posexplode(vec).alias("pos", "x"))
    return parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def packed(items: DataFrame, keys: list[str], order: list[Column], item: str, size: str, budget: int) -> DataFrame:
    """``keys``, used and ids: items of each group in a stated order, as far as they fit; one that doesn't fit is skipped and smaller ones may follow.

    Groups are read in order and only what is packed is held, so they may have any number of items.
    """
    schema = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)
    schema += f", used bigint, ids array<{items.schema[item].dataType.simpleString()}>"

    def on_partition(batches):  # noqa: ANN001, ANN202
        def rows(found):  # noqa: ANN001, ANN202
            return pa.RecordBatch.from_pylist(found, schema=pa.schema([*types, ("used", pa.int64()), ("ids", pa.list_(kind))]))

        group, used, ids, types, kind = None, 0, [], [], None
        for batch in batches:
            types, kind = [batch.schema.field(k) for k in keys], batch.schema.field(item).type
            done = []
            for *key, x, n in zip(*(batch.column(c).to_pylist() for c in (*keys, item, size)), strict=True):
                if key != group:
                    if group is not None:
                        done.append({**dict(zip(keys, group, strict=True)), "used": used, "ids": ids})
                    group, used, ids = key, 0, []
                if n is not None and used + n <= budget:
                    used += n
                    ids.append(x)
            if done:
                yield rows(done)
        if group is not None:
            yield rows([{**dict(zip(keys, group, strict=True)), "used": used, "ids": ids}])

    dealt = items.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*keys, item, size).mapInArrow(on_partition, schema)
