"""WARC archives: writing, reading and revisit resolution by payload digest.

Archives are gzipped text files of Spark's own writer whose line ends are the blank lines that end a WARC
record, so commits, retries and lost executors are Spark's business. A file holds at most
``records_per_file`` records; the reader, who frames records by Content-Length, holds one file's compressed bytes and one record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

CRLF, END = "\r\n", "\r\n\r\n"
# The base32 digits, and the profile of a revisit with the same payload (WARC 1.1).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "record_id string, record_type string, page_id bigint, url string, date string, payload_digest string, payload_bytes bigint, refers_to_id string, refers_to bigint"
#: Rows of revisits that a join may broadcast, at about 150 bytes a row; beyond that it shuffles.
BROADCAST_ROWS = 100_000


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's UTF-8 bytes; 160 bits are 32 digits without padding."""
    digest = F.sha1(payload.cast("binary"))
    quads = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), DIGITS, BASE32)


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; those with a null value are left out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(CRLF)), F.lit("")) for k, v in pairs))


def _write(records: DataFrame, path: str, records_per_file: int) -> None:
    out = records.select(F.concat("head", F.lit(CRLF), "block").alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _framed(df: DataFrame) -> DataFrame:
    """head and block of records given by record_type, record_id, page_id, url, date, payload_digest, payload,
    refers_to_id, refers_to and refers_to_url."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END),
    )
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    head = _lines(
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))), ("WARC-Date", F.col("date")),
        ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), ("WARC-Page-ID", F.col("page_id")),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))), ("WARC-Refers-To", F.concat(F.lit("<"), "refers_to_id", F.lit(">"))),
        ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("refers_to_url"))), ("WARC-Refers-To-Page-ID", F.when(revisit, F.col("refers_to"))),
        ("Content-Type", F.when(revisit, F.lit("message/http")).otherwise(F.lit("application/http;msgtype=response"))),
        ("Content-Length", F.octet_length("block")),
    )
    return df.withColumn("block", block).select(F.concat(F.lit(f"WARC/1.1{CRLF}"), head).alias("head"), "block")


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 2048) -> None:
    """A response record for every row of page_id, url and html; null html is an empty payload.

    Record ids are hashes of the row and its place in the input, so repeated rows are records of their own.
    White space and controls in a URL are percent-encoded; a null URL or page_id leaves its line out.
    """
    url = F.col("url")
    for code in (9, 10, 13, 32):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    url = F.regexp_replace(url, r"[\x00-\x1F\x7F]", "%00")
    df = pages.select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("at"))
    key = F.md5(F.concat_ws("|", F.col("at").cast("string"), F.col("page_id").cast("string"), "url").cast("binary"))
    uid = F.concat_ws("-", *(F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    df = df.select(
        "page_id", "url", "payload", F.octet_length("payload").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"),
        F.lit("response").alias("record_type"), F.concat(F.lit("urn:uuid:"), uid).alias("record_id"), F.lit(date).alias("date"),
        *(F.lit(None).cast("string").alias(c) for c in ("refers_to_id", "refers_to", "refers_to_url")),
    )
    _write(_framed(df), path, records_per_file)


class _Unzipped:
    """Reads a gzipped archive, of one member or several, piece by piece."""

    def __init__(self, data: bytes, piece: int = 1 << 20) -> None:
        self.data, self.at, self.piece, self.member, self.plain = memoryview(data), 0, piece, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Append a piece to ``plain``; False at the end."""
        if self.member.eof:
            if self.at == len(self.data):
                return False
            self.member = zlib.decompressobj(31)
        given = self.member.unconsumed_tail
        if not given:
            given = self.data[self.at : self.at + self.piece]
            self.at += len(given)
        if not len(given):
            raise ValueError("an archive ends within a member")
        self.plain += self.member.decompress(given, self.piece)
        if self.member.eof:
            self.at -= len(self.member.unused_data)
        return True

    def upto(self, n: int) -> bool:
        while len(self.plain) < n:
            if not self.more():
                return False
        return True

    def find(self, what: bytes) -> int:
        at = 0
        while (found := self.plain.find(what, at)) < 0:
            at = max(0, len(self.plain) - len(what) + 1)
            if not self.more():
                return -1
        return found


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a gzipped archive, framed by Content-Length; one record is held at a time."""
    source = _Unzipped(data)
    while source.upto(1):
        end = source.find(b"\r\n\r\n")
        lines = source.plain[:end].decode().split(CRLF) if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = end + 4
        at = start + int(head["Content-Length"])
        if not source.upto(at + 4) or source.plain[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end with a blank line")
        block = bytes(source.plain[start:at])
        del source.plain[: at + 4]
        yield head, block


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record with its header fields; payload_digest and payload_bytes are computed from the payload read,
    for a revisit the digest is its header's and the bytes are null. With ``payloads`` also the payload as a string."""
    schema = HEADERS + (", payload string" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64() if x.endswith("bigint") else pa.string() for x in schema.split(", ")]

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for head, block in _records(content.as_py()):
                    revisit = head["WARC-Type"] == "revisit"
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    number = lambda k, h=head: int(h[k]) if k in h else None
                    bare = lambda k, h=head: h[k].strip("<>") if k in h else None
                    rows.append((
                        bare("WARC-Record-ID"), head["WARC-Type"], number("WARC-Page-ID"), head.get("WARC-Target-URI"), head["WARC-Date"], digest,
                        None if revisit else len(payload), bare("WARC-Refers-To"), number("WARC-Refers-To-Page-ID"), *((payload.decode(),) if payloads else ()),
                    ))
                    size += len(payload)
                    if len(rows) >= 4096 or payloads and size > 4_000_000:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(on_partition, schema)


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(record_id, refers_to_id, refers_to, refers_to_url) of the responses that become revisits.

    Headers only are shuffled, by digest. Of the records of a digest that have ``least_bytes`` or more, the one with
    the largest page_id (ties: the largest record id; a null page_id is the least) stays the response.
    """
    big = headers.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes))
    # grouped by size too, which the digest decides: the join below then has an exchange of its own, and Spark may split a hot digest
    first = big.groupBy("payload_digest", "payload_bytes").agg(
        F.max(F.struct("page_id", "record_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("payload_digest", F.col("first.record_id").alias("refers_to_id"), F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_to_url"))
    return big.select("record_id", "payload_digest").join(first, "payload_digest").where("record_id <> refers_to_id").drop("payload_digest")


def deduplicate(spark: SparkSession, source: str, target: str, scratch: Scratch, least_bytes: int = 0, records_per_file: int = 2048) -> None:
    """Rewrite the archives at ``source`` to ``target`` with revisit records in place of repeated payloads.

    The revisits are broadcast onto the records if there are at most BROADCAST_ROWS of them, else joined by a shuffle.
    """
    revisits = scratch.keep(resolve(read_archives(spark, source), least_bytes), "revisits")
    small = revisits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    records = read_archives(spark, source, payloads=True).drop("refers_to_id", "refers_to")
    joined = records.join(F.broadcast(revisits) if small else revisits, "record_id", "left")
    fresh = F.when(F.col("refers_to_id").isNotNull(), F.lit("revisit")).otherwise(F.col("record_type"))
    _write(_framed(joined.withColumn("record_type", fresh)), target, records_per_file)


def resolved(headers: DataFrame) -> DataFrame:
    """Headers as read, with the size of a revisit's payload taken from the response that it refers to."""
    there = headers.where("record_type = 'revisit'").join(
        headers.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("payload_bytes").alias("b")), "refers_to_id", "left"
    )
    there = there.withColumn("payload_bytes", F.col("b")).select(headers.columns)
    return headers.where("record_type = 'response'").unionByName(there)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as WARC, deduplicate the archives and return what is read back from them, a row for each record."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    first, second = scratch.path("captured"), scratch.path("deduplicated")
    write_archives(pages, first)
    deduplicate(spark, first, second, scratch, least_bytes)
    scratch._delete(first)
    return resolved(scratch.keep(read_archives(spark, second), "headers"))
