"""Decision records found in source comments, commit messages and documents, each with a confidence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import knowledge

# How texts mark decisions and what belongs to them, in the order in which marks count, and words of topics.
DECIDED = (r"@decision\s+(.+)", r"@architecture\s+(.+)", r"ARCHITECTURE\s+DECISION:\s*(.+)", r"DECISION:\s*(.+)", r"Design\s+Decision:\s*(.+)")
WHY = (r"@why\s+(.+)", r"Rationale:\s*(.+)", r"Why:\s*(.+)", r"Reason:\s*(.+)")
ALTERNATIVES = (r"@alternative\s+(.+)", r"Alternatives?:\s*(.+)", r"Options?\s+Considered:\s*(.+)")
CONSEQUENCES = (r"@consequence\s+(.+)", r"Consequences?:\s*(.+)", r"Impact:\s*(.+)")
WORDS = (
    "decided to", "we decided", "the decision was made", "chose to", "selected", "opted for", "adopted", "implemented", "switched to", "migrated to", "replaced",
    "deprecated", "removed",
)
TITLES = ("decision", "architecture", "design", "adr", "rfc", "proposal", "choice", "selection")
TOPICS = (
    "typescript", "javascript", "react", "vue", "angular", "node", "api", "database", "authentication", "security", "performance", "testing", "deployment", "architecture",
    "design",
)
CONVENTIONAL = r"(?i)^(feat|fix|refactor|perf|docs|style|test|chore)(\([^)]*\))?:\s*(.+)$"


def _first(text: Column, patterns: tuple[str, ...]) -> Column:
    """What the first pattern that matches captures, trimmed; null if none does."""
    found = (F.when(text.rlike(f"(?i){p}"), F.trim(F.regexp_extract(text, f"(?i){p}", 1))) for p in patterns)
    return F.coalesce(*found)


def _says(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for w in words:
        hit |= low.contains(w)
    return hit


def topics(text: Column, most: int = 5) -> Column:
    """The first ``most`` topics that a text names."""
    return F.slice(F.filter(F.array(*map(F.lit, TOPICS)), lambda t: F.contains(F.lower(text), t)), 1, most)


def effects(text: Column) -> Column:
    """(positive, negative, neutral): lines of a text by the words in them, list marks taken off; empty lists of null."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[-*]\s*", ""))), lambda x: x != "")
    good = lambda x: F.lower(x).contains("positive") | F.lower(x).contains("benefit")
    bad = lambda x: ~good(x) & (F.lower(x).contains("negative") | F.lower(x).contains("drawback"))
    return F.struct(F.filter(lines, good).alias("positive"), F.filter(lines, bad).alias("negative"), F.filter(lines, lambda x: ~good(x) & ~bad(x)).alias("neutral"))


def comments(files: DataFrame) -> DataFrame:
    """(path, first, last, text) of comments that begin a line: blocks up to the line that ends one, and each line behind // or #."""
    schema = "path string, first int, last int, text string"

    def found(content: str) -> Iterator[tuple[int, int, str]]:
        block: list[str] = []
        begun = 0
        for n, line in enumerate((x.strip() for x in content.split("\n")), 1):
            if not block and line.startswith("/*"):
                begun = n
            if block or line.startswith("/*"):
                block.append(line)
                if line.endswith("*/"):
                    text = "\n".join(block).replace("/**", "").replace("*/", "")
                    yield begun, n, re.sub(r"(?m)^\s*\*\s?", "", text).strip()
                    block = []
            elif line.startswith(("//", "#")):
                yield n, n, re.sub(r"^(//|#)\s*", "", line).strip()

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(found(content or ""))
                if rows:
                    first, last, text = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(text)], ["path", "first", "last", "text"])

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(on_partition, schema)


def _points(*tests: tuple[Column, float]) -> Column:
    return sum((F.when(F.coalesce(t, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0)) for t, w in tests), F.lit(0.0))


def from_code(files: DataFrame) -> DataFrame:
    """(path, first, last, title, decision, why, alternatives, effects, topics, confidence) of comments of files (path, content) that mark a decision or say one.

    A mark gives the decision; without one, a comment with a deciding word is the decision itself and its first sentence the title. Confidence is 0.5
    and a tenth for each: a title of over 5 characters, a decision of over 10, a reason, alternatives, consequences.
    """
    text = F.col("text")
    stated = _first(text, DECIDED)
    sentence = F.trim(F.regexp_extract(text, r"^(.+?)(?:\.|:|\n)", 1))
    title = F.coalesce(stated, F.nullif(sentence, F.lit("")), F.lit("Extracted Decision"))
    rows = comments(files).where(stated.isNotNull() | _says(text, WORDS))
    rows = rows.select("path", "first", "last", title.alias("title"), F.coalesce(stated, text).alias("decision"), _first(text, WHY).alias("why"), _first(text, ALTERNATIVES).alias("alternatives"), _first(text, CONSEQUENCES).alias("consequences"))
    more = _points((F.length("title") > 5, 0.1), (F.length("decision") > 10, 0.1), (F.col("why") != "", 0.1), (F.col("alternatives") != "", 0.1), (F.col("consequences") != "", 0.1))
    shown = rows.select("*", effects(F.col("consequences")).alias("effects"), topics(F.col("decision")).alias("topics"), F.least(F.lit(1.0), F.round(more + 0.5, 6)).alias("confidence"))
    return shown.drop("consequences")


def from_commits(messages: DataFrame, key: str, message: str) -> DataFrame:
    """(key, title, decision, context, topics, confidence) of commit messages that carry a decision.

    Of conventional ones those that add or restructure or speak of architecture, design or decisions, titled with their scope; of others those whose first line
    has a deciding word. Context is the first paragraph that begins with why, reason, context or background. Confidence is 0.6, 0.1 more
    for a title and 0.15 more for a context of over 10 characters.
    """
    first = F.trim(F.get(F.split(F.col(message), "\n"), F.lit(0)))
    body = F.regexp_replace(F.regexp_replace(F.col(message), r"^[^\n]*\n?", ""), r"^\s+|\s+$", "")
    rows = messages.select(F.col(key), first.alias("first"), body.alias("body"))
    kind, scope, subject = (F.regexp_extract("first", CONVENTIONAL, i) for i in (1, 2, 3))
    rows = rows.select(key, "first", "body", kind.alias("kind"), F.regexp_replace(scope, "[()]", "").alias("scope"), subject.alias("subject"))
    structural = F.col("kind").isin("feat", "refactor") | _says(F.col("subject"), ("architect", "design", "decision"))
    kept = rows.where(F.when(F.col("kind") != "", structural).otherwise(_says(F.col("first"), WORDS)))
    decision = F.when(F.col("kind") != "", F.col("subject")).otherwise(F.col("first"))
    title = F.when(F.col("scope") != "", F.concat(F.lit("["), "scope", F.lit("] "), "subject")).otherwise(decision)
    named = F.filter(F.split("body", r"\n\n+"), lambda x: x.rlike("(?i)^(why|reason|context|background)"))
    context = F.coalesce(F.trim(F.regexp_replace(F.get(named, F.lit(0)), r"(?i)^(why|reason|context|background):?\s*", "")), F.lit(""))
    shown = kept.select(key, title.alias("title"), decision.alias("decision"), context.alias("context"))
    more = _points((F.length("title") > 10, 0.1), (F.length("context") > 10, 0.15))
    return shown.select("*", topics(F.col("decision")).alias("topics"), F.least(F.lit(1.0), F.round(more + 0.6, 6)).alias("confidence"))


def from_documents(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, title, decision, effects, topics, confidence) of sections whose title is one of decisions and that have a deciding word; confidence 0.8.

    The decision is the first 500 characters of the section's content.
    """
    found = knowledge.sections(docs.select(key, content), key, content)
    found = found.withColumn("content", F.regexp_replace(F.regexp_replace("content", r"^[^\n]*\n?", ""), r"^\s+|\s+$", ""))  # without its heading
    kept = found.where(_says(F.col("title"), TITLES) & (_says(F.col("title"), WORDS) | _says(F.col("content"), WORDS)))
    shown = kept.select(key, "title", F.substring("content", 1, 500).alias("decision"), effects(_first(F.col("content"), CONSEQUENCES)).alias("effects"))
    return shown.select("*", topics(F.col("decision")).alias("topics"), F.lit(0.8).alias("confidence"))
