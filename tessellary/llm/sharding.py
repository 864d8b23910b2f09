"""Sharding by histogram sort.

Documents are ordered by a hash of their text. Each round counts, over all partitions, the exact bytes below candidate
borders and refines the interval around every wanted splitter, until each splitter meets the tolerance; then rows are
exchanged once. Groups of equal texts stay in one shard; a group of more than a shard's part can't and is dealt out row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Bits of the key that one round of counting refines: 4,096 candidate borders at most for each splitter.
ROUND = 12
#: A splitter's error in bytes, as a part of a shard's mean size.
TOLERANCE = 0.01
#: Rows that one task sorts, and bits of a shard's order that divide it into pieces at most.
SORTED, PIECES = 50_000, 12


def _place(key: Column, bits: int) -> Column:
    """The first ``bits`` bits of an unsigned key of 60 bits."""
    return F.shiftrightunsigned(key, 60 - bits)


def splitters(rows: DataFrame, wanted: list[float], tolerance: float) -> list[int]:
    """Keys (60 bits) so that the bytes of rows (key, size) below the i-th are within ``tolerance`` of wanted[i], or as near as keys allow."""
    best: dict[int, tuple[float, int]] = {}
    probing: dict[int, tuple[int, float]] = {i: (0, 0.0) for i in range(len(wanted))}  # splitter: prefix of its interval, bytes below that
    bits = 0
    while probing and bits < 60:
        prefixes = sorted({p for p, _ in probing.values()})
        counted = rows.where(_place(F.col("key"), bits).isin(prefixes)) if bits else rows
        found = counted.groupBy(_place(F.col("key"), bits + ROUND).alias("p")).agg(F.sum("size").alias("b")).collect()
        inside: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(found, key=lambda r: r.p):
            inside.setdefault(r.p >> ROUND, []).append((r.p, r.b))
        bits += ROUND
        further = {}
        for i, (prefix, below) in probing.items():
            at, done = below, False
            for p, b in inside.get(prefix, []):
                for edge, total in ((p, at), (p + 1, at + b)):
                    best[i] = min(best.get(i, (float("inf"), 0)), (abs(total - wanted[i]), edge << (60 - bits)))
                if at <= wanted[i] < at + b and not done:
                    further[i], done = (p, at), True
                at += b
            if best.get(i, (float("inf"), 0))[0] <= tolerance:
                further.pop(i, None)
        probing = further
    return [best[i][1] if i in best else 0 for i in range(len(wanted))]


def assigned(documents: DataFrame, shards: int = 16, tolerance: float = TOLERANCE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null text has none), text_crc32, shard and slot of every row.

    Bytes of shards are near equal: each splitter is off by ``tolerance`` of a shard at most. Groups of equal texts (single documents
    too) that weigh over half that, or hold as large a part of all rows, are placed first, each on the shard with most room; there are fewer
    than 4 * shards / tolerance. Their rows are sorted by a hash of the row, so that many tasks share them. Splitters then fill up each shard with the rest. Copies that together weigh over a shard's mean are dealt out by row instead. Slots go by text, then doc_id.
    """
    scratch = Scratch(documents.sparkSession, "sharding")
    content = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(content), 4).alias("grp"), F.xxhash64(F.lit(1), content).alias("more"),
    )
    rows = scratch.keep(rows.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    mean = total / shards
    weights = rows.groupBy("grp", "more").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    n = rows.count()
    many = max(SORTED, int(tolerance * n / shards / 2))  # a group of tiny texts weighs little, yet one task would sort it
    heavy = weights.where((F.col("b") > F.lit(tolerance * mean / 2)) | (F.col("n") > many)).orderBy(F.desc("b"), "grp", "more").collect()
    room = [mean] * shards
    placed: list[tuple[int, int, int]] = []
    for g in heavy:
        if g.b > mean and g.n > 1:
            placed.append((g.grp, g.more, -1))
            continue
        s = max(range(shards), key=lambda i: (room[i], -i))
        room[s] -= g.b
        placed.append((g.grp, g.more, s))
    spark = documents.sparkSession
    table = spark.createDataFrame(placed, "grp long, more long, fixed int")
    rows = rows.join(F.broadcast(table), ["grp", "more"], "left")
    salted = F.shiftrightunsigned(F.xxhash64("grp", "more", "doc_id", "rid"), 4)
    rows = rows.withColumn("key", F.when(F.col("fixed") == -1, salted).otherwise(F.col("grp")))
    free = rows.where("fixed is null or fixed = -1")
    over = -sum(min(0.0, r) for r in room)
    spare = sum(max(0.0, r) for r in room)
    wanted, at = [], 0.0
    for r in room[:-1]:
        at += max(0.0, r) * (1 - over / spare if spare else 0)
        wanted.append(at)
    cuts = splitters(free.select("key", "size"), wanted, tolerance * mean / 2)
    shard = F.when(F.col("fixed") >= 0, F.col("fixed")).otherwise(sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in cuts), F.lit(0)))
    # parts of a shard that one task sorts: equal intervals of the order within it, in number by its rows, and the exact rows before each
    rows = rows.withColumn("shard", shard.cast("int"))
    bits = 0
    while bits < PIECES and n >> bits > SORTED:
        bits += 1
    order = F.shiftrightunsigned(F.when(F.col("fixed") >= 0, salted).otherwise(F.col("key")), 60 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("piece", F.when(F.col("fixed") >= 0, order + (1 << bits)).otherwise(order))
    counts = rows.groupBy("shard", "piece").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "piece", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("key", "more", "doc_id", "rid"))
    # counts: at most shards * 2^(PIECES + 1) rows
    out = rows.select("shard", "piece", "doc_id", "size", "text_crc32", (rank - 1).alias("rank")).join(F.broadcast(counts), ["shard", "piece"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"))


def sharded(documents: DataFrame) -> DataFrame:
    """The 16 shards of ``documents`` under the law ``bytes``."""
    return assigned(documents).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
