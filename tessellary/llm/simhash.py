"""SimHash near-duplicates by a hierarchical index in Gray order.

Every distinct fingerprint hangs under four upper nodes, each a mask of 16 bits with the pattern that
its members share there; two fingerprints that differ in at most three bits agree in one of these masks, so they meet under
one upper node at least. Under a node, members are sorted by Gray rank, so that neighbours share long bit
patterns, and grouped level by level; a group keeps the mask of the bits in which all its members agree, and their
pattern. Groups are compared from the top: a pair is dropped as soon as the differences in bits that both
have fixed exceed the limit, with all that is below it. An upper node with more members than a task should hold is
divided by further masks, of which two near fingerprints share one again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import Forest, Scratch, components, give_back, runs, slices, whole_runs

BITS = 64
#: Members under one upper node that a task holds at once.
NODE = 200_000
#: Members of a leaf and children of a node of the index.
FAN = 8
#: Pairs of groups that are compared at once.
PAIRS = 1 << 20


def fingerprint(text: str | None, width: int = 3, words_at_once: int = 100_000) -> int:
    """SimHash of a text's word shingles, repeats included: a bit is set if it is in over half their XXH64 values (seed 42).

    Only A-Z are lower-cased; fewer words than ``width`` are one shingle, no words give 0. Long texts go in blocks.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    total, ones = len(words) - width + 1, np.zeros(BITS, np.int64)
    for low in range(0, total, words_at_once):
        ones += _ones(shingles.shingle_hashes(words[low : low + words_at_once + width - 1], width))
    return _majority(ones, total)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, total: int) -> int:
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def with_fingerprints(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", width: int = 3) -> DataFrame:
    """``keep`` columns and fp, the fingerprint as a signed long, of every row."""
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep) + ", fp bigint"

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in batch.column(len(keep))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps)], [*keep, "fp"])

    return documents.select(*keep, F.col(text).alias("__text")).mapInArrow(on_partition, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each uint64 in the order of the binary reflected Gray code."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class Index:
    """Groups of a sorted run of fingerprints, level by level; ``nodes`` numbers the upper node of each fingerprint, ascending."""

    def __init__(self, fps: np.ndarray, nodes: np.ndarray) -> None:
        of = nodes
        pattern, mask = fps, np.full(len(fps), ~np.uint64(0))
        self.pattern, self.mask, self.first = [pattern], [mask], []
        while len(pattern) and (of[1:] == of[:-1]).any():
            starts = runs([of])
            place = np.arange(len(of)) - np.repeat(starts[:-1], np.diff(starts))
            cut = np.flatnonzero(place % FAN == 0)
            every = np.bitwise_and.reduceat(pattern, cut)
            some = np.bitwise_or.reduceat(pattern, cut)
            mask = np.bitwise_and.reduceat(mask, cut) & ~(every ^ some)
            pattern, of = every & mask, of[cut]
            self.first.append(np.append(cut, len(place)))
            self.pattern.append(pattern)
            self.mask.append(mask)

    def links(self, limit: int, forest: Forest) -> None:
        """Join in ``forest`` all pairs under the same upper node that differ in at most ``limit`` bits.

        A pair of groups carries the bits that both fix and how many of these differ; a level adds what its bits differ in to that.
        """
        top = len(self.first)
        at = np.arange(len(self.pattern[top]))
        work = [(top, at, at, self.mask[top], np.zeros(len(at), np.uint8))]
        while work:
            level, a, b, seen, differ = work.pop()
            if len(a) > PAIRS:
                half = len(a) // 2
                work += [(level, *(x[half:] for x in (a, b, seen, differ))), (level, *(x[:half] for x in (a, b, seen, differ)))]
                continue
            if level == 0:
                forest.union(a, b)
                continue
            first = self.first[level - 1]
            na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
            pair = np.repeat(np.arange(len(a)), na * nb)
            step = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            a, b = first[a][pair] + step // nb[pair], first[b][pair] + step % nb[pair]
            pattern, mask = self.pattern[level - 1], self.mask[level - 1]
            both = mask[a] & mask[b]
            differ = differ[pair] + np.bitwise_count((pattern[a] ^ pattern[b]) & both & ~seen[pair])
            near = (differ <= limit) & (a < b if level == 1 else a <= b)
            if near.any():
                work.append((level - 1, a[near], b[near], both[near], differ[near]))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _masked(fps: DataFrame, limit: int) -> DataFrame:
    """Every fingerprint under limit + 1 nodes: its bits cut in as many masks, with the pattern of each; free are the bits outside the mask."""
    cuts = [BITS * k // (limit + 1) for k in range(limit + 2)]
    nodes = F.array(*(
        F.struct(
            F.xxhash64(F.lit(k), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1))).alias("path"),
            F.lit(_signed(((1 << BITS) - 1) ^ (((1 << (b - a)) - 1) << a))).cast("long").alias("free"),
        ) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
    ))
    return fps.select("fp", F.explode(nodes).alias("node")).select("fp", "node.path", "node.free")


def _divided(nodes: DataFrame, limit: int, depth: int) -> DataFrame:
    """Rows of (fp, path, free) under limit + 1 further nodes each: the bits that are free are dealt out at random to as many masks."""
    order = np.random.default_rng(depth).permutation(BITS)

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, free = (batch.column(c).to_numpy().view(np.uint64) for c in (0, 2))
            for k in range(limit + 1):
                mask = np.zeros(len(fp), np.uint64)
                for value in np.unique(free):
                    bits = [b for b in order.tolist() if int(value) >> b & 1][k :: limit + 1]
                    mask[free == value] = np.uint64(sum(1 << b for b in bits))
                out = [batch.column(0), batch.column(1), pa.array(np.full(len(fp), k, np.int32)), pa.array((fp & mask).view(np.int64)), pa.array((free & ~mask).view(np.int64))]
                yield pa.RecordBatch.from_arrays(out, ["fp", "path", "k", "pattern", "free"])

    made = nodes.select("fp", "path", "free").mapInArrow(on_partition, "fp bigint, path bigint, k int, pattern bigint, free bigint")
    return made.select("fp", F.xxhash64("path", "k", "pattern").alias("path"), "free")


def _edges(nodes: DataFrame, limit: int) -> DataFrame:
    """(a, b) that join the fingerprints that are near under the same node (path, fp), a forest for each task."""

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["path"]):
            paths = table["path"].to_numpy()
            fps = table["fp"].to_numpy().view(np.uint64)
            order = np.lexsort((gray_rank(fps), paths))
            paths, fps = paths[order], fps[order]
            starts = runs([paths])
            number = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            shared = np.repeat(np.diff(starts) > 1, np.diff(starts))
            fps, number = fps[shared], number[shared]
            forest = Forest(len(fps))
            Index(fps, number).links(limit, forest)
            root = forest.flat()
            own = root != np.arange(len(root))
            yield pa.RecordBatch.from_arrays([pa.array(fps[own].view(np.int64)), pa.array(fps[root[own]].view(np.int64))], ["a", "b"])
        give_back()

    dealt = nodes.repartition("path").sortWithinPartitions("path")
    return dealt.mapInArrow(on_partition, "a bigint, b bigint")


def near_pairs(fps: DataFrame, scratch: Scratch, limit: int = 3, node: int = NODE) -> DataFrame:
    """(a, b): links that connect distinct fingerprints (column fp) at most ``limit`` bits apart, as a forest does.

    Nodes of more than ``node`` members are divided by masks over the bits that they don't share yet, of which two near fingerprints agree in
    one again, until all are small; a node of f free bits has 2^f members at most, so that ends. The keys of large nodes are fewer than
    (limit + 1) * fingerprints / node and are broadcast if at most 100,000.
    """
    nodes = _masked(fps, limit)
    done: list[DataFrame] = []
    depth = 0
    while True:
        large = scratch.keep(nodes.groupBy("path", "free").count().where(F.col("count") > node).select("path", F.lit(1).alias("large")).distinct(), "large")
        few = large.limit(100_001).count()
        if not few or depth == BITS:
            done.append(nodes.select("path", "fp"))
            break
        joined = nodes.join(F.broadcast(large) if few <= 100_000 else large, "path", "left")
        done.append(joined.where("large is null").select("path", "fp"))
        depth += 1
        nodes = scratch.keep(_divided(joined.where("large = 1"), limit, depth), "nodes")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return _edges(out, limit)


def groups(documents: DataFrame, limit: int = 3, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, fp and component_id, the least doc_id that links reach, of every row.

    Rows of one fingerprint, copies among them, are one vertex. Documents without words have fingerprint 0 and link like others;
    a null doc_id is never a component_id unless its component has no other.
    """
    scratch = Scratch(documents.sparkSession, "simhash")
    docs = scratch.keep(with_fingerprints(documents, keep, text), "fingerprints")
    least = scratch.keep(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(scratch, near_pairs(least.select("fp"), scratch, limit)).withColumnRenamed("v", "fp")
    member = least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = member.groupBy("root").agg(F.min("least").alias("component_id"))
    found = scratch.keep(member.join(of_root, "root").select("fp", "component_id"), "members")
    return docs.join(found, "fp", "left").select(*keep, "fp", "component_id")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = groups(documents)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(documents: DataFrame, text: str = "text", limit: int = 3) -> DataFrame:
    """doc_id and component_id, the least doc_id that links reach, of every row; texts link if their five-word shingle sets
    have a Jaccard similarity of 0.8 or more.

    SimHashes of the five-word shingles propose first: what the index joins at ``limit`` bits is compared in full, which leaves little of a
    large group of near copies apart. At that similarity two SimHashes differ by some ten bits, beyond what the index reaches, so the
    pairs that it can't propose come from ``shingles.complete``. Rows of equal words are one vertex, those without words too; a null
    doc_id is never a component_id unless its component has no other.
    """
    scratch = Scratch(documents.sparkSession, "near-copies")
    known, often = shingles.frequent(documents, text)
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, key bigint, fp bigint, n int, head array<bigint>, sketch binary, s0 bigint, s1 bigint, s2 bigint, s3 bigint"

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            keys, fps, sizes, heads, sketches, briefs = [], [], [], [], [], []
            for x in batch.column(1):
                words = shingles.words_of(x.as_py())
                hashes = shingles.shingle_hashes(words)
                members = np.unique(hashes)
                keys.append(shingles.key_of(words))
                fps.append(_majority(_ones(hashes), len(hashes)))
                sizes.append(len(members))
                heads.append(shingles.head(members, known, often))
                sketches.append(shingles.sketch(members))
                briefs.append(shingles.brief(members))
            as_longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            parts = [pa.array(np.array([x[i] for x in briefs], np.uint64).view(np.int64)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), as_longs(keys), as_longs(fps), pa.array(sizes, pa.int32()), shingles.lists(heads), pa.array(sketches, pa.binary()), *parts], ["doc_id", "key", "fp", "n", "head", "sketch", *shingles.BRIEF])
        give_back()

    rows = scratch.keep(documents.select("doc_id", text).mapInArrow(on_partition, schema), "heads")
    of_key = rows.groupBy("key").agg(F.min("doc_id").alias("least"), *(F.any_value(c).alias(c) for c in ("fp", "n", "head", "sketch", *shingles.BRIEF)))
    classes = scratch.keep(of_key, "classes")
    met = scratch.keep(shingles.buckets(classes), "buckets")
    first_of = scratch.keep(classes.groupBy("fp").agg(F.min("key").alias("first")), "fingerprints")
    same = classes.hint("merge").join(first_of, "fp").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    near = near_pairs(first_of.select("fp"), scratch, limit)
    for end in ("a", "b"):
        near = near.hint("merge").join(first_of.select(F.col("fp").alias(end), F.col("first").alias(f"key_{end}")), end)
    proposed = scratch.keep(same.unionByName(near.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))), "proposed")
    edges = shingles.verified(proposed, classes, documents, text, scratch)
    roots = shingles.complete(met, edges, classes, documents, text, scratch).withColumnRenamed("v", "key")
    member = classes.select("key", "least").hint("merge").join(roots, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    of_root = member.groupBy("root").agg(F.min("least").alias("component_id"))
    found = scratch.keep(member.hint("merge").join(of_root, "root").select("key", "component_id"), "members")
    return rows.select("doc_id", "key").hint("merge").join(found, "key").select("doc_id", "component_id")
