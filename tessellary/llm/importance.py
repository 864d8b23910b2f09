"""Importance resampling towards a target distribution by hashed n-grams, as an external sort-count.

Each document becomes a packed stream of uint16 buckets, written in blocks with the documents' offsets. Counting sorts each block's
stream and run-length encodes it; scoring reads the streams again, gathers the buckets' gains and adds them up between offsets.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, ranked

#: Buckets that features are hashed to, and consecutive words of the longest feature.
BUCKETS, LONGEST = 10_000, 3
#: Bytes of text that one block takes in; a longer text goes on in the next one. Its stream stays well under a megabyte.
BLOCK = 128_000
#: Words that a document must have to be drawn, and the share of these documents that is drawn, in percent.
LEAST_WORDS, PERCENT = 20, 5

_WORD, _BORDER = re.compile(rb"[0-9a-z\x80-\xFF]+"), re.compile(rb"[\x00-/:-`{-\x7F]")


#: A stretch of a text: row, id, words, how many of them were in the stretch before, whether it is the whole text.
_Piece = tuple[int, object, list[bytes], int, bool]


class Crc:
    """CRC-32 of joined strings from those of their parts, in arrays: appending n bytes is linear in the sum so far.

    One table of 4 x 256 for each digit, to the base 256, that the number of appended bytes may have.
    """

    def __init__(self) -> None:
        # Fixed value: the polynomial, bits reversed.
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
        one = np.array([1 << i for i in range(32)], np.uint32)  # the images of the 32 bits after one more zero byte
        one = (one >> 8) ^ byte[one & 255]
        self.tables = np.zeros((4, 256, 4, 256), np.uint32)
        for level in range(4):
            image = np.array([1 << i for i in range(32)], np.uint32)
            for digit in range(256):
                for k in range(4):
                    for i in range(8):
                        self.tables[level, digit, k, 1 << i : 2 << i] = self.tables[level, digit, k, : 1 << i] ^ image[8 * k + i]
                image = self._apply(one, image)
            one = image

    @staticmethod
    def _apply(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
        bits = (values[:, None] >> np.arange(32, dtype=np.uint32)) & 1
        return np.bitwise_xor.reduce(np.where(bits, matrix, np.uint32(0)), axis=1)

    def join(self, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sums of left + right, where right has ``size`` bytes."""
        for level in range(4):
            digit = (size >> (8 * level)) & 255
            if level and not digit.any():
                continue
            flat = self.tables[level].reshape(-1)
            at = digit * 1024
            left = flat[at + (left & 255)] ^ flat[at + 256 + (left >> 8 & 255)] ^ flat[at + 512 + (left >> 16 & 255)] ^ flat[at + 768 + (left >> 24)]
        return left ^ right


def _pieces(texts: Iterator[tuple[int, object, bytes]], block: int) -> Iterator[_Piece]:
    """Each text, lower-cased, in pieces of about ``block`` bytes, one at least."""
    for rid, doc_id, text in texts:
        low, before, first = 0, [], True
        while first or low < len(text):
            cut = _BORDER.search(text, low + block) if low + block < len(text) else None
            high = cut.start() if cut else len(text)
            words = [*before, *_WORD.findall(text, low, high)]
            yield rid, doc_id, words, len(before), first and high == len(text)
            low, before, first = high, words[len(words) - min(len(words), LONGEST - 1) :], False


def blocks(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Streams of the rows of (id, text): for each block its rows, their words, where their buckets end, whether a row is whole in it.

    A feature is 1 to LONGEST consecutive words joined by a space; its bucket is the CRC-32 of its bytes modulo BUCKETS.
    """
    kind = texts.schema["id"].dataType
    names = ["rids", "ids", "counts", "ends", "whole", "stream"]

    def packed(crc: Crc, held: list[_Piece], id_type: pa.DataType) -> pa.RecordBatch:
        rids, ids, pieces, given, whole = zip(*held, strict=True)
        sizes = np.array([len(p) for p in pieces])
        flat = [w for p in pieces for w in p]
        length = np.fromiter(map(len, flat), np.int64, len(flat))
        word = np.fromiter(map(zlib.crc32, flat), np.uint32, len(flat))
        spaced = crc.join(np.full(len(flat), zlib.crc32(b" "), np.uint32), word, length)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # of a word in its piece
        fresh = place >= np.repeat(given, sizes)
        buckets = np.zeros((len(flat), LONGEST), np.uint16)
        valid = np.zeros((len(flat), LONGEST), bool)
        so_far = word
        for n in range(min(LONGEST, len(flat))):
            if n:  # what ends at the word before, without its own last step, and this word
                so_far = np.append(so_far[:1], crc.join(so_far[:-1], spaced[1:], length[1:] + 1))
            buckets[:, n], valid[:, n] = so_far % BUCKETS, fresh & (place >= n)
        ends = np.append(0, np.cumsum(valid.sum(1)))[np.cumsum(sizes)]
        stream = buckets[valid].astype("<u2").tobytes()
        lists = ((rids, pa.int64()), (ids, id_type), ((sizes - given).tolist(), pa.int64()), (ends.tolist(), pa.int64()), (whole, pa.bool_()))
        arrays = [pa.array([list(x)], pa.list_(t)) for x, t in lists]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([stream], pa.binary())], names)

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, held, size, id_type = Crc(), [], 0, pa.int64()

        def rows() -> Iterator[tuple[int, object, bytes]]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(1).type
                yield from ((r.as_py(), i.as_py(), (t.as_py() or "").encode().lower()) for r, i, t in zip(*batch.columns, strict=True))

        for piece in _pieces(rows(), block):
            held.append(piece)
            size += sum(map(len, piece[2])) + 100
            if size > block:
                yield packed(crc, held, id_type)
                held, size = [], 0
        if held:
            yield packed(crc, held, id_type)
        del held
        give_back()

    schema = f"rids array<bigint>, ids array<{kind.simpleString()}>, counts array<bigint>, ends array<bigint>, whole array<boolean>, stream binary"
    return texts.select(F.monotonically_increasing_id().alias("rid"), "id", "text").mapInArrow(on_partition, schema)


def bucket_counts(streams: DataFrame) -> DataFrame:
    """(bucket, n): every block's stream is sorted and run-length encoded, and each task adds up the runs of its blocks."""

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                run = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
                begins = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
                total[run[begins]] += np.diff(np.append(begins, len(run)))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["bucket", "n"])

    return streams.select("stream").mapInArrow(on_partition, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(here: dict[int, int], there: dict[int, int]) -> np.ndarray:
    """Of each bucket: the floor of 1000 times the logarithm of how much likelier it is ``there``, one added to each count."""
    total, other = sum(here.values()) + BUCKETS, sum(there.values()) + BUCKETS
    each = ((here.get(b, 0) + 1, there.get(b, 0) + 1) for b in range(BUCKETS))
    return np.array([math.floor(1000 * math.log((t * total) / (s * other))) for s, t in each], np.int64)


def _noise(doc_id: object) -> int:
    """A Gumbel number in thousandths, rounded down, by the SHA-256 of ``42:<doc_id>`` (nothing after the colon for null)."""
    h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of ``streams``; a row without features has weight 0."""
    kind = streams.schema["ids"].dataType.elementType.simpleString()
    names = ["rid", "doc_id", "n_words", "n_features", "weight", "noise", "whole"]

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rids, ids, counts, ends, whole = (batch.column(c)[i].values for c in range(5))
                end = ends.to_numpy()
                begin = np.append(0, end[:-1])
                full = np.flatnonzero(end > begin)  # reduceat would give an empty stretch the gain after it
                sums = np.zeros(len(end), np.int64)
                if len(full):
                    sums[full] = np.add.reduceat(gain[np.frombuffer(batch.column(5)[i].as_buffer(), "<u2")], begin[full])
                noise = pa.array(map(_noise, ids.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([rids, ids, counts, pa.array(end - begin), pa.array(sums), noise, whole], names)

    schema = f"rid bigint, doc_id {kind}, n_words bigint, n_features bigint, weight bigint, noise bigint, whole boolean"
    each = streams.select("rids", "ids", "counts", "ends", "whole", "stream").mapInArrow(on_partition, schema)
    parts = each.where("not whole").groupBy("rid", "doc_id", "noise").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    whole = each.where("whole").select("doc_id", "n_words", "n_features", "weight", "noise").unionByName(parts.drop("rid"))
    return whole.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))


def resampled(documents: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``documents``; ``target`` is any frame with texts like those wanted.

    Of the N rows with at least ``least_words`` words the floor of ``percent`` * N / 100 best scores are drawn, ties to the smaller
    doc_id, null last; rank is null for all others. Null texts are empty and have neither features nor weight. Rows that repeat
    a doc_id are rows of their own. Other columns are left out. A text of any length goes through in pieces of ``block`` bytes.
    """
    scratch = Scratch(documents.sparkSession, "importance")
    # rows are numbered as the streams are written, so the numbers are the same at every reading
    streams = scratch.keep(blocks(documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), block), "streams")
    wanted = blocks(target.select(F.lit(None).cast("long").alias("id"), F.col(text).alias("text")))
    here, there = (dict(map(tuple, bucket_counts(x).collect())) for x in (streams, wanted))  # at most BUCKETS rows each
    scored = scratch.keep(scores(streams, gains(here, there)), "scores")
    scratch.drop(streams)
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = ranked(scratch, eligible, order).withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    return placed.select(*columns).unionByName(rest.select(*columns))
