"""Conventional commits and changelogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Commit types in the order of a changelog, and other names for them.
TYPES = ("feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore", "revert")
ALIASES = {"feature": "feat", "bugfix": "fix", "documentation": "docs", "tests": "test", "performance": "perf"}
HEADER = r"^(\w+)(?:\(([^)]+)\))?(!)?:\s*(.+)$"


def commit_type(word: Column) -> Column:
    """The type that a word names, ``chore`` if none."""
    names = F.create_map(*(F.lit(x) for pair in [*((t, t) for t in TYPES), *ALIASES.items()] for x in pair))
    return F.coalesce(F.try_element_at(names, F.lower(word)), F.lit("chore"))


def parsed(commits: DataFrame, message: str) -> DataFrame:
    """``commits`` with type, scope, description, breaking and issues of their messages."""
    first = F.substring_index(message, "\n", 1)
    part = lambda i: F.regexp_extract(first, HEADER, i)
    known = first.rlike(HEADER)
    return commits.withColumns({
        "type": F.when(known, commit_type(part(1))).otherwise("chore"), "scope": F.nullif(part(2), F.lit("")),
        "description": F.when(known, F.trim(part(4))).otherwise(first),
        "breaking": (part(3) == "!") | F.col(message).contains("BREAKING CHANGE:"), "issues": tx.issues(F.col(message)),
    })


def next_version(commits: DataFrame) -> DataFrame:
    """One row, the kind of the next version: major if anything breaks, minor for a feature, else patch."""
    return commits.agg(F.bool_or("breaking").alias("b"), F.bool_or(F.col("type") == "feat").alias("f")).select(
        F.when(F.col("b"), "major").when(F.col("f"), "minor").otherwise("patch").alias("bump")
    )


def version_number(version: Column) -> Column:
    """major * 10000 + minor * 100 + patch."""
    parts = F.split(version, r"\.")
    return sum((F.coalesce(F.try_element_at(parts, F.lit(i + 1)).try_cast("long"), F.lit(0)) * w for i, w in enumerate((10000, 100, 1))), F.lit(0)).cast("long")


def with_body(commits: DataFrame, message: str) -> DataFrame:
    """``commits`` with body, footers (an array of key and value), breaking and note, of the lines after a message's first.

    Footers (``Key: value``) begin with the first one that no line of the body precedes, or with a breaking change; after that, only footers and
    breaking changes count. The last breaking change is the note; a message without a body has a null one.
    """
    lines = F.slice(F.split(message, "\n"), F.lit(2), F.greatest(F.size(F.split(message, "\n")) - 1, F.lit(0)))
    breaking, footer = r"(?i)^BREAKING[ -]CHANGE:\s*(.+)$", r"^([A-Za-z-]+):\s*(.+)$"
    kinds = F.transform(lines, lambda x: F.when(F.trim(x) == "", "blank").when(x.rlike(breaking), "breaking").when(x.rlike(footer), "footer").otherwise("other"))
    far = F.size("__lines") + 1
    place = lambda kind: F.coalesce(F.nullif(F.array_position("__kinds", kind), F.lit(0).cast("long")), far.cast("long"))
    begun = F.least(place("breaking"), F.when(place("footer") < place("other"), place("footer")).otherwise(far.cast("long")))
    rows = commits.withColumn("__lines", lines).withColumn("__kinds", kinds).withColumn("__begun", begun.cast("int"))
    body = F.regexp_replace(F.array_join(F.slice("__lines", F.lit(1), F.col("__begun") - 1), "\n"), r"^\s+|\s+$", "")
    said = lambda kind: F.filter("__lines", lambda x, i: (i + 1 >= F.col("__begun")) & (F.get("__kinds", i) == kind))
    footers = F.transform(said("footer"), lambda x: F.struct(F.regexp_extract(x, footer, 1).alias("key"), F.regexp_extract(x, footer, 2).alias("value")))
    notes = F.transform(said("breaking"), lambda x: F.regexp_extract(x, breaking, 1))
    return rows.withColumns({
        "body": F.nullif(body, F.lit("")), "footers": footers, "breaking": F.array_contains("__kinds", "breaking"), "note": F.try_element_at(notes, F.lit(-1)),
    }).drop("__lines", "__kinds", "__begun")


def summary(commits: DataFrame, key: str) -> DataFrame:
    """(key, summary): a sentence with the features, fixes and breaking changes of each group of commits (type, breaking); empty if there are none."""
    some = ((F.col("type") == "feat", "new feature", "s"), (F.col("type") == "fix", "bug fix", "es"), (F.col("breaking"), "breaking change", "s"))
    counts = commits.groupBy(key).agg(*(F.count_if(test).alias(f"__{i}") for i, (test, _, _) in enumerate(some)))
    parts = [F.when(F.col(f"__{i}") > 0, F.concat(F.col(f"__{i}").cast("string"), F.lit(f" {what}"), F.when(F.col(f"__{i}") > 1, more).otherwise(""))) for i, (_, what, more) in enumerate(some)]
    said = F.concat_ws(", ", *parts)
    return counts.select(key, F.when(said == "", "").otherwise(F.concat(F.lit("This release includes "), said, F.lit("."))).alias("summary"))
