"""Differences between versions of a page by its sections, and long pages cut into parts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import knowledge


def section_diff(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, title, change, removed, added): sections of two Markdown texts by title as added, deleted, modified or unchanged.

    Of sections of one title in one text the last counts; white space around contents doesn't. ``removed`` and ``added`` are the lines, in order, that the
    other content lacks, empty but for modified ones. Text before the first heading is in no section; null texts have none.
    """

    def side(text: str, name: str) -> DataFrame:
        found = knowledge.sections(pairs.select(key, text), key, text)
        body = F.trim(F.regexp_replace("content", r"^[^\n]*\n?", ""), F.lit(" \t\r\n"))
        return found.groupBy(key, "title").agg(F.max_by(body, "order").alias(name))

    both = side(old, "__old").join(side(new, "__new"), [key, "title"], "full")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted").when(F.col("__old") != F.col("__new"), "modified").otherwise("unchanged")
    lines = lambda c: F.split(c, "\n", -1)
    only = lambda a, b: F.when(change == "modified", F.filter(lines(a), lambda x: ~F.array_contains(lines(b), x))).otherwise(F.expr("cast(array() as array<string>)"))
    return both.select(key, "title", change.alias("change"), only("__old", "__new").alias("removed"), only("__new", "__old").alias("added"))


def parts_of(text: str, most: int) -> Iterator[str]:
    """Parts of a text of about ``most`` characters: second-level sections packed as long as they fit, or, without any, stretches that end before
    their last line break if that lies in their last fifth."""
    sections = text.split("\n## ")
    if len(sections) > 1:
        held = sections[0]
        for section in ("\n## " + s for s in sections[1:]):
            if len(held) + len(section) > most:
                yield held.strip()
                held = section
            else:
                held += section
        if held.strip():
            yield held.strip()
        return
    at = 0
    while at < len(text):
        cut = text.rfind("\n", at, at + most) - at
        size = cut if cut > most * 0.8 and at + most < len(text) else most
        yield text[at : at + size]
        at += size


def split_texts(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, n, part): the parts of each text, numbered from 0; empty texts are one empty part, null ones have none. Lengths are code points."""
    kind = docs.schema[key].dataType.simpleString()

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in enumerate(batch.column(1)):
                parts = list(parts_of(value.as_py(), most)) or [""] if value.is_valid else []
                for low in range(0, len(parts), 1_000):
                    some = parts[low : low + 1_000]
                    places = pa.array([row] * len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(places), pa.array(range(low, low + len(some)), pa.int32()), pa.array(some, pa.string())], [key, "n", "part"])

    return docs.select(key, F.col(text).alias("__text")).mapInArrow(on_partition, f"`{key}` {kind}, n int, part string")
