"""From raw documents to token ids: language identification, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellary.llm import bpe, langid, mixing, simhash
from tessellary.llm.common import Scratch, word_count
from tessellary.llm.queries import VOCABULARY

#: Words that a worker remembers while it encodes: fewer than alone, as executors still hold what the stages before used.
WORDS = 100_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of ids that a join may broadcast, 8 bytes each; beyond that it shuffles.
BROADCAST_ROWS = 500_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those with null text or no letter (``und``) go."""
    model = langid.learn(docs, "lang", "text")
    return langid.identify(docs, model, keep=COLUMNS).where(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group that SimHash proposes and five-word Jaccard similarities of 0.8 or more link.

    Rows that repeat a doc_id stay or go together, those without one stay.
    """
    scratch = Scratch(spark, "pipeline")
    gone = simhash.near_copies(docs).where("doc_id <> component_id").select("doc_id").distinct()
    gone = scratch.keep(gone, "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times; rows that repeat a doc_id share a decision."""
    scratch = Scratch(spark, "pipeline")
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit(None).cast("long").alias("payload"))
    taken = mixing.copies(sizes, scratch).groupBy("doc_id").agg(F.max("taken").alias("taken")).where("taken > 0")
    taken = scratch.keep(taken.withColumnRenamed("doc_id", "id"), "taken")
    # one way at every size: a decision for each document is too much to broadcast, so both sides are sorted by id
    joined = docs.join(taken.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")))
    return joined.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("taken")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every row."""
    return bpe.encoded(docs, VOCABULARY, forget=True, remembered=WORDS)


STAGES = [
    ("language identification", identify_language), ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources), ("BPE encoding", encode),
]
#: Shingles and rounding by chance have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
