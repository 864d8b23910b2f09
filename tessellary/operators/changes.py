"""Snapshots, their differences, and what follows from a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(*parts: Column, length: int = 32) -> Column:
    """The first ``length`` hex digits of the MD5 of columns joined by a bar; null counts as empty."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.substring(F.md5(text.cast("binary")), 1, length)


def sorted_hash(parts: Column) -> Column:
    """MD5 of an array of strings that doesn't depend on their order."""
    return F.md5(F.array_join(F.array_sort(parts), "|").cast("binary"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str, unchanged: bool = False) -> DataFrame:
    """(key, change, old_hash, new_hash): added, deleted and modified keys, and unchanged ones if wanted."""
    a = old.select(key, F.col(digest).alias("old_hash"), F.lit(True).alias("__old"))
    b = new.select(key, F.col(digest).alias("new_hash"), F.lit(True).alias("__new"))
    kind = (
        F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified").otherwise("unchanged")
    )
    both = a.join(b, key, "full_outer").select(key, kind.alias("change"), "old_hash", "new_hash")
    return both if unchanged else both.where("change <> 'unchanged'")


def summary(changes: DataFrame) -> DataFrame:
    """One row: the number of changes of each kind and in all."""
    count = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    return changes.agg(count("added"), count("modified"), count("deleted"), F.count_if(F.col("change") != "unchanged").alias("total"))


def change_percentage(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(changed, total, percentage): changed keys against those of the old snapshot and added ones; 100 without an old snapshot."""
    d = snapshot_diff(old, new, key, digest, unchanged=True)
    counts = d.agg(F.count_if(F.col("change") != "unchanged").alias("changed"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("percentage", F.coalesce(F.try_divide(F.col("changed") * 100.0, F.col("total")), F.lit(100.0)))


def renames(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(old_key, new_key): content that is under another key now. The last old key of a content counts, and the last new key of that one."""
    a = old.groupBy(digest).agg(F.max(key).alias("old_key"))
    b = new.select(F.col(key).alias("new_key"), digest)
    return a.join(b, digest).where("old_key <> new_key").groupBy("old_key").agg(F.max("new_key").alias("new_key"))


def one_hop(changed: DataFrame, edges: DataFrame, key: str = "id", source: str = "src", target: str = "dst") -> DataFrame:
    """Changed keys and all that depend on one of them (an edge goes from dependent to dependency)."""
    dependents = edges.join(changed.select(F.col(key).alias(target)), target, "left_semi").select(F.col(source).alias(key))
    return changed.select(key).union(dependents).distinct()


def affected_pages(pages: DataFrame, changed: DataFrame, page: str, file: str) -> DataFrame:
    """Pages with any source file among the changed ones."""
    return pages.join(changed.select(file).distinct(), file, "left_semi").select(page).distinct()


def exact_copies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, copies, first): contents that occur more than once."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest")
    return docs.select(digest, key).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first")).where("copies > 1")


def latest(rows: DataFrame, by: str, value: str, at: str) -> DataFrame:
    """(by, value): the value of the greatest time of each key, ties to the greater value."""
    return rows.groupBy(by).agg(F.max(F.struct(at, value)).getField(value).alias(value))


def newest(rows: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each key in the given order; tasks keep no more before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= keep)


def line_diff(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, line, change, old_line, new_line): lines that differ at the same place."""
    side = lambda c, name: pairs.select(key, F.posexplode(F.split(c, "\n", -1)).alias("line", name))
    both = side(old, "old_line").join(side(new, "new_line"), [key, "line"], "full_outer")
    kind = F.when(F.col("old_line").isNull(), "added").when(F.col("new_line").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old_line").eqNullSafe(F.col("new_line"))).select(key, "line", kind.alias("change"), "old_line", "new_line")


def merge_sections(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Upsert by section: new content replaces old, old without new stays."""
    a = old.select(*keys, F.col(value).alias("__old"))
    b = new.select(*keys, F.col(value).alias("__new"))
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("__new", "__old").alias(value))
