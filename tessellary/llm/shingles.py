"""Five-word shingle sets of texts, and the exact way to all pairs whose Jaccard similarity is 0.8 or more.

Sets are sorted in one order of all shingles, those that a sample of documents shows to be frequent last. Two sets that
alike share one of their first n - ceil(0.8 n) + 1 shingles, so these alone are dealt out. Rows that meet there are a bucket.
Pairs are compared only across components that are known to be apart: a large group of near copies is joined by a few pairs for
each member, never by all. A sketch of a bit or two for each shingle turns down most pairs that aren't alike, and none that is; whole
sets are made for the rest alone. The order decides what it costs, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, give_back, runs, slices, whole_runs

WIDTH = 5
#: Least similarity, as a fraction, so that it is compared in integers.
OVER, UNDER = 4, 5
#: Documents that are sampled for the order of shingles, and the most frequent shingles that a task is given.
SAMPLE, FREQUENT = 20_000, 100_000
#: Bits of the map that says which documents' sets are wanted (8 MB at every size; a document too many costs time only).
WANTED = 26
#: A sketch folded to 256 bits, as four longs, that every row of a bucket carries.
BRIEF = ("s0", "s1", "s2", "s3")
#: Pairs that one step over buckets emits at most.
STEP = 1 << 18
#: Rows of a bucket up to which it is compared in full once, which is (SMALL - 1) / 2 pairs a row at most; it changes no result.
SMALL = 8
#: Pairs for each row of the buckets up to which all are compared without further rounds of neighbours; it changes no result.
FEW = 1


def words_of(text: str | None) -> list[bytes]:
    """Words of a text; only A-Z are lower-cased."""
    return (text or "").encode().lower().split()


def key_of(words: list[bytes]) -> int:
    """What texts of equal words share."""
    return xxhash.xxh64_intdigest(b" ".join(words), 42)


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """XXH64 values (seed 42) of all shingles, repeats included; fewer words than ``width`` are one shingle, no words none."""
    if len(words) < width:
        return np.array([key_of(words)] if words else [], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(x, 42) for x in map(join, zip(*(words[i:] for i in range(width)), strict=False))], np.uint64)


def shingle_set(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The distinct ``shingle_hashes``, ascending."""
    return np.unique(shingle_hashes(words, width))


def alike(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of ``a`` and ``b`` members that share so many have a Jaccard similarity of 0.8 or more."""
    return UNDER * shared >= OVER * (a + b - shared)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def frequent(documents: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of documents shows at least three times, ascending, and how often."""

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            sets = [shingle_set(words_of(x.as_py())) for x in batch.column(0)]
            seen, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n)], ["shingle", "n"])
        give_back()

    part = min(1.0, SAMPLE / max(1, documents.count()))
    rows = documents.select(text) if part == 1 else documents.select(text).sample(part, 1)
    counts = rows.mapInArrow(on_partition, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where("n >= 3")
    found = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    shingles = found["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], found["n"].to_numpy()[order]


def head(members: np.ndarray, known: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order."""
    s = members
    if len(known) and len(s):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        s = s[np.argsort(np.where(known[at] == s, often[at], 0), kind="stable")]
    return s[: len(s) - -(-OVER * len(s) // UNDER) + 1]


def buckets(classes: DataFrame) -> DataFrame:
    """(shingle, key, n, at, m): the rows of ``classes`` (key, n, head) that share a first shingle with another they may be alike with.

    ``m`` is how many of these the bucket has. From ``at`` on, a set of n shingles shares n - at at most, so it can't be alike with one of more than ``most`` = 9/4 (n - at) - n shingles.
    """

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["shingle"]):
            starts = runs([table["shingle"].to_numpy()])
            number = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            n, at = (table[c].to_numpy().astype(np.int64) for c in ("n", "at"))
            most = (UNDER + OVER) * (n - at) // OVER - n
            # sizes ascend within a bucket; what lies in other buckets is lifted out of reach
            lift = int(max(n.max(), most.max()) - min(0, most.min())) + 1
            before = np.append(-1, np.maximum.accumulate(most + number * lift)[:-1])
            larger = (before >= n + number * lift) & (UNDER * most >= OVER * n) & np.append(False, number[1:] == number[:-1])
            after = np.append(n[1:], 0)
            smaller = (after <= most) & np.append(number[1:] == number[:-1], False)
            kept = larger | smaller
            m = np.bincount(number[kept], minlength=len(starts) - 1)[number[kept]].astype(np.int32)
            yield from table.filter(pa.array(kept)).append_column("m", pa.array(m)).to_batches()
        give_back()

    rows = classes.select("key", "n", F.posexplode("head").alias("at", "shingle")).select("shingle", "key", "n", "at")
    return rows.repartition("shingle").sortWithinPartitions("shingle", "n").mapInArrow(on_partition, "shingle bigint, key bigint, n int, at int, m int")


def pairs(met: DataFrame, order: str | None = None, reach: int = 1) -> DataFrame:
    """(a, b): keys of one bucket of ``met`` (shingle, key, n, at, comp, s0 to s3) that lie in different components and may be alike by their
    sizes and places and by their brief sketches.

    All of them; or, with ``order`` (an expression), each row with the next ``reach`` ones only.
    """

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["shingle"]):
            shingle, comp, key, n, at = (table[c].to_numpy() for c in ("shingle", "comp", "key", "n", "at"))
            n, at = n.astype(np.int64), at.astype(np.int64)
            brief = [table[c].to_numpy().view(np.uint64) for c in BRIEF]
            starts = runs([shingle])
            ends = np.repeat(starts[1:], np.diff(starts))
            if order is None:
                # rows go by component, so those of others are all behind the end of a row's own
                own = runs([shingle, comp])
                first = np.repeat(own[1:], np.diff(own))
            else:
                first = np.arange(1, len(key) + 1)
                ends = np.minimum(ends, first + reach)
            i = np.flatnonzero(first < ends)
            if not len(i):
                continue
            many = (ends - first)[i]
            cuts = np.flatnonzero(np.diff(np.cumsum(many) // STEP, prepend=-1))
            for low, high in zip(cuts, [*cuts[1:], len(i)], strict=True):
                x, m = i[low:high], many[low:high]
                for skip in range(0, int(m.max()), STEP):  # a row with more partners than a step meets them in turn
                    part = np.clip(m - skip, 0, STEP)
                    a = np.repeat(x, part)
                    b = np.arange(len(a)) - np.repeat(np.cumsum(part) - part, part) + first[a] + skip
                    most = np.minimum(n[a] - at[a], n[b] - at[b])
                    near = alike(most, n[a], n[b]) & (comp[a] != comp[b])
                    a, b = a[near], b[near]
                    odd = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in brief)
                    near = (OVER + UNDER) * odd <= (UNDER - OVER) * (n[a] + n[b])
                    a, b = key[a[near]], key[b[near]]
                    met_ = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(met_[0]), pa.array(met_[1])], ["a", "b"])
        give_back()

    return met.repartition("shingle").sortWithinPartitions("shingle", F.expr(order or "comp"), "key").mapInArrow(on_partition, "a bigint, b bigint").distinct()


def brief(members: np.ndarray) -> np.ndarray:
    """A sketch of 256 places, as four longs, whatever the set's size."""
    odd = np.bincount((members & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def sketch(members: np.ndarray) -> bytes:
    """Whether an odd number of the set's members falls on each of 2^k >= n places (64 at least), a bit each.

    Two sets differ in at least as many members as their sketches (the larger one folded) differ in bits.
    """
    places = 64
    while places < len(members):
        places *= 2
    odd = np.bincount((members & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Least number of members that the sets of two sketches differ in."""
    if len(a) > len(b):
        a, b = b, a
    x = np.frombuffer(a, np.uint64)
    y = np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def screened(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches (of ``classes``: key, n, sketch) allow them to be alike."""

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column(2).to_numpy() + batch.column(4).to_numpy()).tolist()
            x, y = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            # 5 shared >= 4 (a + b - shared) means that at most a ninth of a + b differ
            keep = [(OVER + UNDER) * differing(s, t) <= (UNDER - OVER) * m for s, t, m in zip(x, y, most, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    ends = [classes.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in ("a", "b")]
    both = candidates.hint("merge").join(ends[0].hint("merge"), "a").hint("merge").join(ends[1].hint("merge"), "b")
    return both.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(on_partition, "a bigint, b bigint")


def wanted_map(ids: DataFrame) -> np.ndarray:
    """A map of 2^WANTED bits of the ids (doc_id: long), made by the tasks; the driver gets at most one row for each 64 bits."""
    place = F.col("doc_id").bitwiseXOR(F.shiftright("doc_id", WANTED)).bitwiseAND(F.lit((1 << WANTED) - 1))
    words = ids.where("doc_id is not null").select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (WANTED - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def sets_of(documents: DataFrame, shared: Broadcast, text: str) -> DataFrame:
    """(key, members): the shingle sets of the documents that a ``wanted_map`` holds, once each; a few others may come along. Null ids are wanted."""

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(0)
            place = given.fill_null(0).to_numpy()
            place = (place ^ (place >> WANTED)) & ((1 << WANTED) - 1)
            hit = (shared.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
            part = batch.column(1).filter(pa.array((hit > 0) | given.is_null().to_numpy(zero_copy_only=False)))
            for piece in slices(iter([pa.RecordBatch.from_arrays([part], ["text"])]), 0):
                words = [words_of(x.as_py()) for x in piece.column(0)]
                keys = np.array([key_of(w) for w in words], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), lists([shingle_set(w) for w in words])], ["key", "members"])
        give_back()

    rows = documents.select(F.col("doc_id").cast("long"), text).mapInArrow(on_partition, "key bigint, members array<bigint>")
    return rows.groupBy("key").agg(F.any_value("members").alias("members"))


def verified(candidates: DataFrame, classes: DataFrame, documents: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of keys whose sets are alike; what sketches leave is compared in full, a row at a time, joined by sorts at every size."""
    if candidates.isEmpty():
        return candidates.select("a", "b")
    left = scratch.keep(screened(candidates, classes), "screened")
    if left.isEmpty():
        return left
    keys = left.select(F.col("a").alias("key")).union(left.select("b")).distinct()
    ids = classes.select("key", F.col("least").cast("long").alias("doc_id")).hint("merge").join(keys.hint("merge"), "key", "left_semi")
    shared = documents.sparkSession.sparkContext.broadcast(wanted_map(ids))
    sets = scratch.keep(sets_of(documents, shared, text), "sets")
    shared.destroy()  # else every round's map stays with all workers
    x, y = sets.select(F.col("key").alias("a"), F.col("members").alias("x")), sets.select(F.col("key").alias("b"), F.col("members").alias("y"))
    both = left.hint("merge").join(x.hint("merge"), "a").hint("merge").join(y.hint("merge"), "b").select("a", "b", "x", "y")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("n"))
    out = scratch.keep(both.where(F.col("shared") * UNDER >= (F.col("n") - F.col("shared")) * OVER).select("a", "b"), "alike")
    scratch.drop(sets)
    return out


def apart(placed: DataFrame) -> tuple[float, float]:
    """Rows of buckets (shingle, comp), and pairs of rows of one bucket that lie in different components."""
    of = placed.groupBy("shingle", "comp").agg(F.count(F.lit(1)).cast("double").alias("m"))
    of = of.groupBy("shingle").agg(F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("own"))
    found = of.agg(F.sum("rows"), F.sum((F.col("rows") * F.col("rows") - F.col("own")) / 2)).first()
    return found[0] or 0.0, found[1] or 0.0


def complete(met: DataFrame, edges: DataFrame, classes: DataFrame, documents: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """(v, root): the components of ``edges`` and of all pairs in the buckets ``met`` whose sets are alike.

    Neighbours in size and by chance, of these more from round to round, are compared first in buckets of over SMALL rows, which joins most of a group,
    as a member needs to be like one of it only; what is still apart then is compared in full, and as soon as that is no more than FEW pairs a row.
    Small buckets wait for this last round, and a large one that lies in one component is left out of all after it: neither is joined with the components in each.
    """
    briefs = classes.select("key", *BRIEF)
    met = scratch.keep(met.hint("merge").join(briefs.hint("merge"), "key"), "met")
    found = components(scratch, edges)
    large = met.where(F.col("m") > SMALL)

    def with_components(rows: DataFrame) -> DataFrame:
        of = found.select(F.col("v").alias("key"), "root")
        return rows.hint("merge").join(of.hint("merge"), "key", "left").select("shingle", "key", "n", "at", "m", *BRIEF, F.coalesce("root", "key").alias("comp"))

    for order, reach in (("n", 1), ("xxhash64(1, key)", 1), ("xxhash64(2, key)", 8), ("xxhash64(3, key)", 64), (None, 0)):
        placed = scratch.keep(with_components(large), "placed")
        rows, left = apart(placed)
        if left <= FEW * rows:
            order = None
        if order is None:
            placed = placed.unionByName(with_components(met.where(F.col("m") <= SMALL)))
        more = verified(scratch.keep(pairs(placed, order, reach), "candidates"), classes, documents, text, scratch) if left or order is None else None
        if order is not None:
            split = placed.groupBy("shingle").agg((F.min("comp") < F.max("comp")).alias("split")).where("split").select("shingle")
            large = scratch.keep(placed.hint("merge").join(split.hint("merge"), "shingle", "left_semi").drop("comp"), "large")
            scratch.drop(placed)
        if more is not None and not more.isEmpty():
            edges = edges.unionByName(more)
            found = components(scratch, edges)
        if order is None:
            break
    return found
