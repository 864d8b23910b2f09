"""Sections, knowledge nodes, reviews and conflicts: one projection or one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import alike

# Words that raise or lower a review's score, and how long a node of each type takes to read.
PRAISE = ("优秀", "良好", "完整", "准确", "清晰")
BLAME = ("缺失", "错误", "不完整", "模糊", "问题")
MINUTES = {"concept": 1.0, "api": 2.0, "pattern": 3.0, "module": 4.0, "component": 2.0, "page": 1.5, "decision": 2.0}


def sections(pages: DataFrame, key: str, content: str) -> DataFrame:
    """(key, order, level, title, content) of every Markdown section; one ends where the next heading of any level begins.

    Text before the first heading is in none; null and heading-free texts have none.
    """
    parts = F.filter(F.split(content, r"(?m)(?=^#{1,6} .)"), lambda x: x.rlike(r"^#{1,6} ."))
    rows = pages.select(key, F.posexplode(parts).alias("order", "__part"))
    head = F.substring_index("__part", "\n", 1)
    return rows.select(
        key, "order", F.length(F.regexp_extract(head, "^(#+) ", 1)).alias("level"), F.trim(F.regexp_replace(head, "^#+ ", "")).alias("title"),
        F.regexp_replace("__part", r"^\s+|\s+$", "").alias("content"),
    )


def term_positions(text: Column, term: str) -> Column:
    """Offsets (from 0) of a term in a text, case apart, that don't overlap; a null text or an empty term has none."""
    if not term:
        return F.array().cast("array<int>")
    parts = F.split(F.lower(text), r"\Q" + term.lower() + r"\E", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def add(state: Column, part: Column) -> Column:
        here = state["at"] + F.length(part)
        return F.struct((here + len(term)).alias("at"), F.concat(state["found"], F.array(here)).alias("found"))

    found = F.aggregate(parts, start, add, lambda s: s["found"])
    return F.coalesce(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array().cast("array<int>"))


def patterns(pages: DataFrame, key: str, content: str, keywords: dict[str, tuple[str, ...]], least: int = 2) -> DataFrame:
    """(key, pattern, hits): patterns whose keywords occur as whole words ``least`` times in a page, case apart. One pass, no join."""
    text = F.lower(content)
    counts = F.array(*(F.struct(F.lit(p).alias("pattern"), sum((F.regexp_count(text, F.lit(rf"\b{w}\b")) for w in words), F.lit(0)).alias("hits")) for p, words in keywords.items()))
    return pages.select(key, F.explode(F.filter(counts, lambda c: c["hits"] >= least)).alias("c")).select(key, "c.pattern", "c.hits")


def pattern_nodes(found: DataFrame, key: str) -> DataFrame:
    """(pattern, pages, importance) over the rows of ``patterns``: 0.3 for each page, 1 at most."""
    pages = F.count_distinct(key)
    return found.groupBy("pattern").agg(pages.alias("pages"), F.least(F.lit(1.0), F.round(pages * 0.3, 6)).alias("importance"))


def reading_minutes(kind: Column, importance: Column) -> Column:
    """Minutes for a node: 15 times its type's factor (1 for others) and 5 for full importance, rounded half up."""
    factors = F.create_map(*(F.lit(x) for pair in MINUTES.items() for x in pair))
    return F.floor(F.coalesce(F.try_element_at(factors, kind), F.lit(1.0)) * 15 + importance * 5 + 0.5).cast("int")


def review_score(review: Column) -> Column:
    """The score that a review states, or n / 10; else 7 and half a point up or down for each word of praise or blame, 1 to 10."""
    stated = F.coalesce(*(F.nullif(F.regexp_extract(review, p, 1), F.lit("")) for p in (r"评分[：:]\s*(\d+)", r"(\d+)\s*/\s*10")))
    words = sum((F.when(F.contains(review, F.lit(w)), x).otherwise(0.0) for ws, x in ((PRAISE, 0.5), (BLAME, -0.5)) for w in ws), F.lit(7.0))
    return F.coalesce(stated.cast("int"), F.greatest(F.lit(1), F.least(F.lit(10), F.floor(words + 0.5).cast("int"))))


def resolution(kind: Column, ours: Column, theirs: Column, ours_length: Column, theirs_length: Column, apart: Column) -> Column:
    """How to settle a conflict: by hand for binary and deleted files; else the newer side, else one half as long again as the other, else a
    merge where the changed sections lie ``apart``, else by hand."""
    return (
        F.when(kind.isin("binary", "delete-modify"), "manual").when(ours > theirs, "keep-local").when(theirs > ours, "keep-remote")
        .when(theirs_length > ours_length * 1.5, "keep-remote").when(ours_length > theirs_length * 1.5, "keep-local").when(apart, "merge").otherwise("manual")
    )


def invalidated(entries: DataFrame, types: list[str] | None = None, tags: list[str] | None = None, **equal: object) -> Column:
    """Whether an entry is deleted: it matches all that is given; if nothing is given every entry does."""
    tests = [F.col("type").isin(types)] if types is not None else []
    tests += [F.arrays_overlap("tags", F.array(*map(F.lit, tags)))] if tags is not None else []
    tests += [F.col(c) == F.lit(v) for c, v in equal.items()]
    hit = F.lit(True)
    for test in tests:
        hit &= F.coalesce(test, F.lit(False))
    return hit


def merged_sections(rows: DataFrame, key: str) -> DataFrame:
    """One section for each key of rows (key, at, tags, priority, level, content): tags in order of first use, least priority and level, and
    contents joined by a rule if every row has one, else null."""
    ordered = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("at", "tags", "content"))).alias("r"), F.min("priority").alias("priority"), F.min("level").alias("level"),
        F.bool_and(F.coalesce(F.col("content") != "", F.lit(False))).alias("full"),
    )
    return ordered.select(
        key, F.array_distinct(F.flatten("r.tags")).alias("tags"), "priority", "level", F.when(F.col("full"), F.array_join("r.content", "\n\n---\n\n")).alias("content")
    )


def linked(links: DataFrame, ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(id, other): a link table read in both directions, each pair once, none with itself."""
    x, y = ends
    both = links.select(F.col(x).alias("id"), F.col(y).alias("other")).union(links.select(F.col(y), F.col(x)))
    return both.where("id <> other").distinct()


def similar_nodes(nodes: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, similarity) for a < b of nodes (id, name, tags, page, file): 0.4 of the tags' Jaccard, 0.3 for one page, 0.2 for one file, 0.1 if a
    name holds the other. ``least`` is over 0.1, so alike nodes share a tag, a page or a file; they are met where these suffice, and scored as they meet.
    """
    if least <= 0.1:
        raise ValueError("pairs that share nothing but a part of their names can't be joined by a key")
    tags = F.array_distinct(F.transform("tags", F.lower)).alias("tags")
    rows = nodes.select("id", F.lower("name").alias("name"), tags, F.col("page").cast("string").alias("page"), F.col("file").cast("string").alias("file")).where("tags is not null")
    met = alike.pairs(rows, None, least, strict=False, value=lambda likeness, _: F.round(likeness, 6))
    return met.select("a", "b", F.col("value").alias("similarity")).where(F.col("similarity") >= least)


def json_in(text: Column) -> Column:
    """The JSON text from the first brace to the last, or from bracket to bracket; null if it doesn't parse."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in (r"(?s)\{.*\}", r"(?s)\[.*\]")))
    return F.when(F.get_json_object(found, "$").isNotNull(), found)


def ranked(rows: DataFrame, by: list[str], order: list) -> DataFrame:  # noqa: ANN001
    """``rows`` with place, their rank from 1 within ``by`` in ``order``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def complexity(tests: list[Column]) -> Column:
    """basic if at most one test holds, intermediate if at most three, else advanced; null is false."""
    score = sum((F.when(t, 1).otherwise(0) for t in tests), F.lit(0))
    return F.when(score <= 1, "basic").when(score <= 3, "intermediate").otherwise("advanced")


def conflicted(status: Column) -> Column:
    """Paths that both sides changed or added, of the lines of a short git status."""
    lines = F.filter(F.split(status, "\n"), lambda x: x.rlike("^(UU|AA) "))
    return F.transform(lines, lambda x: F.trim(F.substring(x, 4, 1 << 20)))


def union_nodes(of_type: dict[str, DataFrame], name: dict[str, str]) -> DataFrame:
    """(type, name, importance) of all nodes of several tables, each of one type with its own name column; nothing is merged."""
    out = None
    for kind, nodes in of_type.items():
        rows = nodes.select(F.lit(kind).alias("type"), F.col(name[kind]).alias("name"), F.col("importance").cast("double").alias("importance"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no tables of nodes")
    return out
