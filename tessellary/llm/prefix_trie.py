"""Prefix tries of conversations from mergeable partial tries.

A prefix is keyed by the sum of wide hashes of (depth, role, text) over its turns, modulo 2^32 in each of eight lanes. As depths differ within
a prefix, equal keys mean equal sequences, and the keys of a conversation are running sums, so a long one may be cut anywhere.
Every task makes a table of the nodes that it meets, with members and end lists; tables of the same key are merged in a
tree of rounds, and what hangs below each node is rolled up by jumps that double.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ranked, word_count

#: Lanes of a key; turns of a conversation that one task sums up; tables that one merge takes in; ids that one end list spans; nodes that a task holds.
LANES, CHUNK, FAN, SPAN, HELD = 8, 4096, 64, 1024, 200_000
_LANES = [f"k{i}" for i in range(LANES)]


def _lanes(depth: str, digest: str) -> list[Column]:
    """The lanes of a turn's hash, unsigned 32 bits each; zeros without a turn."""
    h = F.sha2(F.concat_ws(":", F.col(depth).cast("string"), F.col(digest)), 256)
    lane = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")
    return [F.when(F.col(digest).isNull(), F.lit(0)).otherwise(lane(i)).alias(c) for i, c in enumerate(_LANES)]


def _key(lanes: list[Column]) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for x in lanes)))


def rebuilt(conversations: DataFrame, scratch: Scratch, family: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, depth, digest, words, last) of every rebuilt turn, and of every conversation once with depth 0.

    Conversation c takes the first h = crc32(c) % ``heads`` turns of c - c % ``family`` (of the sign of c), then its own after the first h.
    Turns are ordered by turn, null first, then by the digest of role and text. ``last`` is the rebuilt conversation's number of turns.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), word_count(text).alias("words"))
    turns = ranked(scratch, turns, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]).drop("turn")
    known = turns.groupBy("conv_id").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).alias("h")
    known = scratch.keep(known.select("conv_id", "first", "n", h, (F.col("conv_id") - F.col("conv_id") % family).alias("base")), "conversations")
    bases = known.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")
    last = (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("last")
    known = scratch.keep(known.join(bases, "base", "left").select("*", taken).select("conv_id", "first", "n", "h", "base", "taken", last), "heads")
    placed = scratch.keep(turns.join(known, "conv_id").withColumn("at", F.col("place") - F.col("first")), "turns")
    own = placed.where("at >= h").select("conv_id", (F.col("taken") + F.col("at") - F.col("h") + 1).alias("depth"), "digest", "words", "last")
    # a family's first turns, fewer than ``heads``, go to at most 2 x ``family`` conversations
    given = placed.where(F.col("at") < heads - 1).select(F.col("conv_id").alias("base"), "at", "digest", "words")
    given = given.join(known.select("conv_id", "base", "taken", "last"), "base").where("at < taken")
    given = given.select("conv_id", (F.col("at") + 1).alias("depth"), "digest", "words", "last")
    roots = known.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("words"), "last")
    return own.unionByName(given).unionByName(roots)


def keyed(turns: DataFrame, scratch: Scratch, size: int = CHUNK) -> DataFrame:
    """(conv_id, depth, words, last, key, parent) of every rebuilt turn: running sums in chunks of ``size`` turns, then over chunks."""
    rows = turns.select("*", F.floor(F.col("depth") / size).alias("chunk"), *_lanes("depth", "digest")).drop("digest")
    rows = scratch.keep(rows, "lanes")
    chunk = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    long = rows.where(F.col("last") >= size).groupBy("conv_id", "chunk").agg(*(F.sum(c).alias(c) for c in _LANES))
    # at most one row for ``size`` turns of a conversation; sums of fewer than 2^31 of 32 bits can't overflow
    long = long.select("conv_id", "chunk", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b{c}") for c in _LANES))
    sums = rows.select("conv_id", "chunk", "depth", "words", "last", *_LANES, *(F.sum(c).over(chunk).alias(f"s{c}") for c in _LANES))
    whole = sums.join(long, ["conv_id", "chunk"], "left")
    upto = [F.col(f"s{c}") + F.coalesce(F.col(f"b{c}"), F.lit(0)) for c in _LANES]
    parent = F.when(F.col("depth") > 0, _key([u - F.col(c) for u, c in zip(upto, _LANES, strict=True)]))
    return whole.select("conv_id", "depth", "words", "last", _key(upto).alias("key"), parent.alias("parent"))


def partial_tries(turns: DataFrame) -> DataFrame:
    """(part, key, parent, depth, words, n_convs, conv_id, slice, ends): nodes (slice null) with members and smallest member of what a task
    has seen, and end lists, ids in ascending order, one for each node and SPAN ids. A task emits its table when it holds HELD rows."""
    names = ["part", "key", "parent", "depth", "words", "n_convs", "conv_id", "slice", "ends"]

    def table(batch: pa.Table, part: int) -> Iterator[pa.RecordBatch]:
        nodes = batch.group_by("key").aggregate([("parent", "min"), ("depth", "min"), ("words", "min"), ("conv_id", "count"), ("conv_id", "min")])
        n, none = nodes.num_rows, lambda n, t: pa.nulls(n, t)
        columns = [nodes[c].combine_chunks() for c in ("key", "parent_min", "depth_min", "words_min", "conv_id_count", "conv_id_min")]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), *columns, none(n, pa.int64()), none(n, pa.list_(pa.int64()))], names)
        ends = batch.filter(pa.compute.equal(batch["depth"], batch["last"])).select(["key", "conv_id"])
        ends = ends.append_column("slice", pa.array(ends["conv_id"].to_numpy() // SPAN)).sort_by("conv_id")
        lists = ends.group_by(["key", "slice"], use_threads=False).aggregate([("conv_id", "list")])
        n = lists.num_rows
        rest = [none(n, t) for t in (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), lists["key"].combine_chunks(), *rest, lists["slice"].combine_chunks(), lists["conv_id_list"].combine_chunks()], names)

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, n = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield from table(pa.Table.from_batches(held).combine_chunks(), part)
                held, n = [], 0
        if n:
            yield from table(pa.Table.from_batches(held).combine_chunks(), part)

    schema = "part bigint, key binary, parent binary, depth bigint, words bigint, n_convs bigint, conv_id bigint, slice bigint, ends array<bigint>"
    return turns.select("key", "parent", "depth", "words", "last", "conv_id").mapInArrow(on_partition, schema)


def merged(tables: DataFrame, scratch: Scratch, fan: int = FAN) -> DataFrame:
    """One row for each node and end list: rounds of merges by key, of ``fan`` tables each, until one is left. A list has at most SPAN ids."""
    kept = scratch.keep(tables, "tables")
    parts = (kept.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        groups = ["part", "key", "slice"] if parts > fan else ["key", "slice"]
        sums = [F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.sum("n_convs").alias("n_convs")]
        ends = F.sort_array(F.flatten(F.collect_list("ends"))).alias("ends")
        cut = kept.withColumn("part", F.floor(F.col("part") / fan))
        nodes = cut.where("slice is null").groupBy(*groups).agg(*sums, F.min("conv_id").alias("conv_id"), F.lit(None).cast("array<bigint>").alias("ends"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("parent", "binary"), ("depth", "long"), ("words", "long"), ("n_convs", "long"), ("conv_id", "long"))]
        lists = cut.where("slice is not null").groupBy(*groups).agg(*none, ends)
        before, kept = kept, scratch.keep(nodes.unionByName(lists), "tables")
        scratch.drop(before)
        if parts <= fan:
            return kept
        parts = -(-parts // fan)


def ends_digests(lists: DataFrame) -> DataFrame:
    """(key, ends_sha256) from (key, slice, ends): ids joined by commas run through the hash list by list, in ascending order.

    The hash of a node is sequential by its law, so its lists, up to SPAN ids a row, pass through one task; it holds one batch of them.
    """

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            keys, digests = [], []
            for k, ends in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = ",".join(map(str, ends.as_py())).encode()
                if k == key:
                    h.update(b"," + text)
                    continue
                if key is not None:
                    keys.append(key)
                    digests.append(h.hexdigest())
                key, h = k, hashlib.sha256(text)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], ["key", "ends_sha256"])

    dealt = lists.repartition("key").sortWithinPartitions("key", "slice").select("key", "ends")
    return dealt.mapInArrow(on_partition, "key binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, scratch: Scratch, sums: tuple[str, ...]) -> DataFrame:
    """(key, sums) of whole subtrees from (key, parent, depth, sums) of single nodes.

    After round r a node holds the sums of all within 2^r levels below it and points 2^r levels up; so the rounds
    are as many as the greatest depth has binary digits, and only nodes deep enough still point anywhere.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    state = nodes.select("key", F.col("parent").alias("up"), *sums)
    for _ in range(deepest.bit_length()):
        below = state.where("up is not null").groupBy("up").agg(*(F.sum(c).alias(f"b_{c}") for c in sums)).withColumnRenamed("up", "key")
        added = state.join(below, "key", "left").select("key", "up", *(F.col(c) + F.coalesce(f"b_{c}", F.lit(0)) for c in sums)).toDF("key", "up", *sums)
        jumps = state.where("up is not null").select(F.col("key").alias("up"), F.col("up").alias("next"))
        before, state = state, scratch.keep(added.join(jumps, "up", "left").select("key", F.col("next").alias("up"), *sums), "rollup")
        scratch.drop(before)
    return state.select("key", *sums)


def trie(conversations: DataFrame, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Every node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role, text; null is empty), its members are the conversations that begin with it. Rows without
    conv_id belong to no conversation. Rows of the same turn are ordered by a digest of role and text, repeated rows are turns of their
    own. No conversation, no node. Other columns are left out. Only digests and word counts of turns are shuffled, never texts.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    tables = merged(partial_tries(keyed(rebuilt(conversations, scratch), scratch, size)), scratch, fan)
    nodes, lists = tables.where("slice is null").drop("slice", "ends", "part"), tables.where("slice is not null")
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "key")
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents, "parent", "left").withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).select("*", saved)
    nodes = scratch.keep(nodes, "nodes")
    whole = rolled_up(nodes, scratch, ("n_leaves", "saved_tokens"))
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.drop("n_leaves", "saved_tokens").join(whole, "key").join(ends_digests(lists), "key", "left")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return out.select(*columns, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
