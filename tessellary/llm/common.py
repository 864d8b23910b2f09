"""What several operators of this subpackage share: scratch tables, sorted runs, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Code points that end a word, as a Java class: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own in local mode, else an error,
    as no executor of a cluster could read the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessellary-")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what went before.

    ``keep`` writes a frame and returns it as read again; ``drop`` deletes a table early; the rest go at exit.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(self._delete, self.root)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (kept, path)
        return kept

    def drop(self, kept: DataFrame) -> None:
        if found := self.paths.pop(id(kept), None):
            self._delete(found[1])

    def _delete(self, path: str) -> None:
        try:
            jvm, sc = self.spark._jvm, self.spark.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session has ended; a scratch folder is left over, no result is lost
            return


def give_back() -> None:
    """Return what this Python worker has freed to the system: it lives on between stages, and all workers of an executor share its memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches of about ``size`` bytes in a text column, a single row at least."""
    for batch in batches:
        low = total = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            total += n or 0
            if total > size:
                yield batch.slice(low, i + 1 - low)
                low, total = i + 1, 0
        if low < batch.num_rows:
            yield batch.slice(low)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin in columns of the same length, and that length at the end."""
    n = len(columns[0]) if columns else 0
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def whole_runs(
    batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 262_144
) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows, cut from sorted batches only where a key ends."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(runs([table[k].to_numpy(zero_copy_only=False) for k in keys])[-2])
        if not cut:
            held = table.to_batches()
            continue
        yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        n = table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def by_runs(
    df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Deal rows out by ``keys``, sort each partition and hand ``fn`` tables that hold whole groups."""

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, keys):
            yield from fn(table)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(on_partition, schema)


def ranked(scratch: Scratch, df: DataFrame, order: list[Column], rows: int = 1_000_000) -> DataFrame:
    """``df`` with ``place``, each row's place in ``order`` from 0 on; equal rows stand in any order.

    Rows are dealt out by ranges of about ``rows``, sorted and numbered in each; what the ranges before hold, one number a range, is added.
    """
    dealt = df.repartitionByRange(1 + df.count() // rows, *order).sortWithinPartitions(*order)
    dealt = scratch.keep(dealt.withColumn("__id", F.monotonically_increasing_id()), "ranges")  # the range's number and 33 bits for the row's
    part = F.shiftright("__id", 33).alias("__part")
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy(part).count().select("__part", before.alias("__before"))
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn("place", place).drop("__part", "__before", "__id")


class Forest:
    """Disjoint sets over 0..n-1 that take edges in arrays; a set's root is its smallest member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n, dtype=np.int64)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                return r
            r = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def flat(self) -> np.ndarray:
        self.parent = self.roots(np.arange(len(self.parent)))
        return self.parent


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b: long, not null); root is one vertex of its component.

    Each round every vertex points to the neighbour (or itself) of least hash, edges are renamed by
    these pointers and merged, until none is left; hashed order makes the number of rounds grow with
    the logarithm of the longest path. All tables of a round lie in the shared folder, and as both
    sides of each join come from there, Spark can split the partitions of a hot vertex.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    left = scratch.keep(edges.where("a <> b").select("a", "b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(
            F.col("a").alias("v"), F.least(rank("a"), F.col("m")).getField("v").alias("p")
        )
        pointer = scratch.keep(pointer, "pointer")
        maps.append(pointer)
        to_a, to_b = (pointer.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in ("a", "b"))
        renamed = left.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        renamed = renamed.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        before, left = left, scratch.keep(renamed, "edges")
        scratch.drop(before)
    if not maps:
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = maps[0].select("v", F.col("p").alias("root"))
    for pointer in maps[1:]:
        step = pointer.select(F.col("v").alias("root"), "p")
        out = out.join(step, "root", "left").select("v", F.coalesce("p", "root").alias("root"))
    return scratch.keep(out, "components")
