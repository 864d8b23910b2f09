"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is wanted target / source size times. The whole part is taken outright; the fractions
are rounded in pairs: mass (words) moves from one document to the other, in a random direction that keeps both
expectations, until one fraction is 0 or 1. Each bucket of documents leaves one open fraction for each source; a
reduction tree pairs these on, and the last one is rounded by chance. So a source's taken words miss its target by less than
one document's size, of a small one where there are any (see ``copies``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, word_count

#: Documents of a bucket, and buckets whose open fractions one node of the tree takes in.
BUCKET, FAN = 20_000, 64
#: Sources that one task ranks.
RANKED = 1_000_000
#: Sizes at which one class of documents ends and the next begins, as parts of the mean size in a source.
CLASSES = (1.0, 0.25)
_COLUMNS = "doc_id bigint, payload bigint, source string, size bigint, source_size bigint, target double, whole int, mass double, bucket bigint, open boolean, taken int"


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in order of their code points, null last, weigh ``weights`` in turn and share all sizes; a target stops at ``most`` times
    its source's size, and the excess is shared by weight among the rest until none is above. The frame of
    sources is pre-aggregated by every task; each step of the sharing is an aggregate of two numbers.
    """
    sources = scratch.keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    # ranks: sorted by ranges, numbered in each, with the sources of the ranges before added
    parts = 1 + sources.count() // RANKED
    dealt = sources.repartitionByRange(parts, F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id())
    dealt = scratch.keep(dealt, "ranges")
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy("part").count().select("part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) + F.col("before") - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    sources = scratch.keep(dealt.join(F.broadcast(ranges), "part").withColumn("weight", w).drop("part", "before"), "weights")
    left = sources.agg(F.sum("source_size")).first()[0] or 0
    weight = sources.agg(F.sum("weight")).first()[0] or 0
    cap = F.col("source_size") * most
    per = 0.0
    while weight:
        per = left / weight
        # those above their cap now; as shares only grow, they stay above
        capped = sources.where(F.col("weight") * F.lit(per) > cap).agg(F.sum(cap), F.sum("weight")).first()
        total = sources.agg(F.sum("source_size"), F.sum("weight")).first()
        new_left, new_weight = total[0] - (capped[0] or 0), total[1] - (capped[1] or 0)
        if new_weight == weight:
            break
        left, weight = new_left, new_weight
    target = F.least(F.col("weight") * F.lit(float(per)), cap.cast("double"))
    return sources.select("source", "source_size", target.alias("target"))


def _chance(seed: int, *parts: object) -> float:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return (xxhash.xxh64_intdigest(repr((seed, *parts)).encode(), 0) >> 11) / (1 << 53)


def _moved(chance: float, a_mass: float, a_size: int, b_mass: float, b_size: int) -> tuple[float, float]:
    """Masses of two open documents after one of them has become 0 or whole; both expectations are kept."""
    up, down = min(a_size - a_mass, b_mass), min(a_mass, b_size - b_mass)  # from b to a, from a to b
    if chance * (up + down) < down:
        full, none = a_size - a_mass <= b_mass, b_mass <= a_size - a_mass
        return (float(a_size) if full else a_mass + up), (0.0 if none else b_mass - up)
    none, full = a_mass <= b_size - b_mass, b_size - b_mass <= a_mass
    return (0.0 if none else a_mass - down), (float(b_size) if full else b_mass + down)


def _level(rows: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """Round every bucket; rows whose copies are settled get ``taken`` and are no longer open.

    A batch's columns are arrays; the chain of open rows alone is walked, and at most one row waits for the next batch.
    """

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # doc_id, size, mass and (bucket, source) of the open row, and the row it came from
        waiting: pa.RecordBatch | None = None  # that row, if it came with an earlier batch

        def final(row: tuple) -> float:
            key, size, mass, (_, source) = row[:4]
            if last and 0 < mass < size:
                mass = size * float(_chance(seed, "last", key, source) * size < mass)
            return mass

        def with_mass(batch: pa.RecordBatch, mass: np.ndarray) -> pa.RecordBatch:
            size, whole, was = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("size", "whole", "open"))
            open_ = (mass > 0) & (mass < size)
            taken = np.where(was, whole + ((size > 0) & (mass >= size)), batch.column("taken").to_numpy()).astype(np.int32)
            made = {"mass": pa.array(mass), "open": pa.array(open_ & was), "taken": pa.array(taken)}
            return pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in batch.schema.names], schema=batch.schema)

        for batch in batches:
            mass = batch.column("mass").to_numpy().copy()
            places = np.flatnonzero(batch.column("open").to_numpy(zero_copy_only=False))
            some = batch.take(pa.array(places))
            columns = (some.column(n).to_pylist() for n in ("doc_id", "size", "mass", "bucket", "source"))
            late: list[float] = []  # the settled mass of the row that waited
            own = -1  # where the open row stands in this batch
            for place, key, size, m, bucket, source in zip(places.tolist(), *columns, strict=True):
                if held is not None and held[3] != (bucket, source):
                    (late.append(final(held)) if own < 0 else mass.__setitem__(own, final(held)))
                    held = None
                if held is None:
                    held, own = (key, size, m, (bucket, source)), place
                    continue
                x, y = _moved(_chance(seed, level, held[0], key, held[1], size), held[2], held[1], m, size)
                if 0 < y < size:
                    (late.append(x) if own < 0 else mass.__setitem__(own, x))
                    held, own = (key, size, y, (bucket, source)), place
                else:
                    mass[place] = y
                    held = (*held[:2], x, held[3])
                    if not 0 < x < held[1]:
                        (late.append(x) if own < 0 else mass.__setitem__(own, x))
                        held = None
            if late:
                yield with_mass(waiting, np.array(late))
                waiting = None
            if held is not None and own >= 0:
                waiting = batch.slice(own, 1)
                yield with_mass(pa.RecordBatch.from_arrays([c.filter(pa.array(np.arange(len(mass)) != own)) for c in batch.columns], schema=batch.schema), np.delete(mass, own))
            else:
                yield with_mass(batch, mass)
        if held is not None:
            yield with_mass(waiting, np.array([final(held)]))

    order = ["bucket", "source", "size", "doc_id", "payload"]
    return rows.repartition("bucket").sortWithinPartitions(*order).mapInArrow(on_partition, _COLUMNS)


def _rounded_class(rows: DataFrame, scratch: Scratch, buckets: int, seed: int) -> DataFrame:
    """The reduction tree over rows with whole and mass: all of them with taken, settled at one level or another."""
    level, done = 0, None
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("long"))
    while True:
        found = scratch.keep(_level(rows, seed, level, buckets == 1), f"level{level}")
        settled = found.where("not open")
        done = settled if done is None else done.unionByName(settled)
        if buckets == 1:
            return done
        buckets = -(-buckets // FAN)
        level += 1
        rows = found.where("open").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))


def copies(documents: DataFrame, scratch: Scratch, seed: int = 11, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, payload, size, source_size, target and taken (copies, at most ``most``) of every row of doc_id, source, size and payload.

    Documents over their source's mean size are rounded first, then those over a quarter of it, then the rest; what one class misses is
    made up for by the probabilities of the next, so that the last error is as small as small documents are.
    Chance depends on ids and sizes alone and buckets on the hash of the id and the number of rows, so reruns agree however the
    input is dealt out. Within a bucket documents go by size, so mass moves between documents of like size. Rows of size 0 have no mass.
    Sources are joined by a broadcast if there are at most 100,000 of them, else by a shuffle; payload is any number to carry along.
    """
    docs = scratch.keep(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("payload").cast("long").alias("payload"), F.col("source").cast("string").alias("source"), "size"), "sizes")
    targets = source_targets(docs, scratch, weights, most)
    numbers = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("s"), "n")
    targets = targets.join(numbers, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    targets = scratch.keep(targets.withColumn("missed", F.lit(0.0)), "targets")
    few = targets.limit(100_001).count() <= 100_000
    buckets = 1 << max(0, -(-docs.count() // BUCKET) - 1).bit_length()
    out = None
    for k in range(len(CLASSES) + 1):
        s = targets.select(F.col("source").alias("s"), "source_size", "target", "n", "missed")
        rows = docs.join(F.broadcast(s) if few else s, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        mean = F.col("source_size") / F.col("n")
        if k:
            rows = rows.where(F.col("size") < mean * CLASSES[k - 1])
        if k < len(CLASSES):
            rows = rows.where(F.col("size") >= mean * CLASSES[k])
        held = rows.groupBy("source").agg(F.sum("size").alias("held")).select(F.col("source").alias("h"), "held")
        rows = rows.join(F.broadcast(held) if few else held, F.col("source").eqNullSafe(F.col("h"))).drop("h")
        per = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
        per = per + F.coalesce(F.try_divide(F.col("missed"), F.col("held").cast("double")), F.lit(0.0))
        per = F.least(F.greatest(per, F.lit(0.0)), F.lit(float(most)))
        whole = F.floor(per + 1e-12).cast("int")
        mass = F.greatest(per - whole, F.lit(0.0)) * F.col("size")
        rows = rows.select(
            "doc_id", "payload", "source", "size", "source_size", "target", whole.alias("whole"), mass.alias("mass"),
            F.lit(0).cast("long").alias("bucket"), (mass > 0).alias("open"), whole.alias("taken"),
        )
        done = _rounded_class(rows, scratch, buckets, seed + k)
        out = done if out is None else out.unionByName(done)
        if k < len(CLASSES):
            # what the classes so far should have had, less what was taken
            got = out.groupBy("source").agg(
                F.sum(F.col("size") * F.try_divide(F.col("target"), F.col("source_size").cast("double")) - F.col("size") * F.col("taken")).alias("missed")
            )
            got = got.select(F.col("source").alias("g"), F.round("missed", 6).alias("missed"))
            targets = targets.drop("missed").join(got, F.col("source").eqNullSafe(F.col("g")), "left").drop("g")
            targets = scratch.keep(targets.withColumn("missed", F.coalesce("missed", F.lit(0.0))), "targets")
    return out.select("doc_id", "payload", "source", "size", "source_size", "target", "taken")


def mixed(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    scratch = Scratch(documents.sparkSession, "mixing")
    docs = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit(None).cast("long").alias("payload"))
    out = copies(docs, scratch)
    return out.select("doc_id", "size", "source_size", "target", (F.col("taken") * F.col("size")).alias("taken"))
