"""Quality scores, classification by rules and heuristics, and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("double")


def readability(text: Column) -> Column:
    """100, less 15 for long sentences (over 25 words on average), 10 for long paragraphs (150), 10 for many complex words (a fifth over ten letters)."""
    def mean(parts: Column) -> Column:
        total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + F.size(F.split(x, r"\s+")))
        return F.coalesce(F.try_divide(total, F.size(parts).cast("double")), F.lit(0.0))

    sentences = F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(s) != "")
    paragraphs = F.filter(F.split(text, r"\n\n+"), lambda s: F.trim(s) != "")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    complex_ = F.size(F.filter(words, lambda w: F.length(w) > 10))
    ratio = F.coalesce(F.try_divide(complex_.cast("double"), F.size(words).cast("double")), F.lit(0.0))
    cut = F.when(mean(sentences) > 25, 15).otherwise(0) + F.when(mean(paragraphs) > 150, 10).otherwise(0) + F.when(ratio > 0.2, 10).otherwise(0)
    return (F.lit(100) - cut).cast("int")


def structure(text: Column) -> Column:
    """100, less 30 without headings, 15 for a depth over 4, 10 for a skipped level, 5 for over ten headings without contents."""
    marks = F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6}) .+$"), F.lit(1))
    depths = F.transform(marks, F.length)
    skipped = F.exists(F.zip_with(depths, F.slice(depths, F.lit(2), F.greatest(F.size(depths), F.lit(1))), lambda a, b: b - a), lambda d: F.coalesce(d, F.lit(0)) > 1)
    contents = text.contains("## Table of Contents") | text.contains("## Contents")
    cut = F.when(F.size(marks) == 0, 30).otherwise(0) + F.when(F.coalesce(F.array_max(depths), F.lit(0)) > 4, 15).otherwise(0)
    cut = cut + F.when(skipped, 10).otherwise(0) + F.when((F.size(marks) > 10) & ~contents, 5).otherwise(0)
    return (F.lit(100) - cut).cast("int")


def coverage(text: Column) -> Column:
    """100, less 40 under 100 words or 20 under 300, 15 for code words without a code block, 10 without a link."""
    n = _words(text)
    code = F.lower(text).rlike("function|class|method|api|interface|type")
    cut = F.when(n < 100, 40).when(n < 300, 20).otherwise(0) + F.when(code & ~text.contains("```"), 15).otherwise(0)
    return (F.lit(100) - cut - F.when(F.size(tx.markdown_links(text)) == 0, 10).otherwise(0)).cast("int")


def freshness(updated: Column, now: Column) -> Column:
    """100, less 20 for an unknown date, 30 over a year, 15 over half of one."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(updated)) / 86400)
    return (F.lit(100) - F.when(updated.isNull(), 20).when(days > 365, 30).when(days > 180, 15).otherwise(0)).cast("int")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def weighted(scores: list[tuple[Column, float]]) -> Column:
    """Weighted mean, rounded half up."""
    total = sum((s * w for s, w in scores), F.lit(0.0))
    return F.floor(total / sum(w for _, w in scores) + 0.5).cast("int")


def classify(docs: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, category, score): rules (rule, category, priority, pattern, weight) are rows, one for each condition; best score, then priority.

    The rules are a dimension of bounded size and broadcast. A rule's score is its matching weights over its number of conditions.
    """
    sizes = rules.groupBy("rule").agg(F.count(F.lit(1)).alias("conditions"))
    dim = rules.join(sizes, "rule")
    met = docs.select(key, F.lower(text).alias("__t")).join(F.broadcast(dim), F.col("__t").contains(F.col("pattern")))
    scored = met.groupBy(key, "rule", "category", "priority").agg((F.sum("weight") / F.max("conditions")).alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.desc("priority"), "rule"))
    best = scored.withColumn("r", rank).where("r = 1")
    return docs.select(key).join(best.select(key, "category", "score"), key, "left").select(key, F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("score", F.lit(0.0)).alias("score"))


def risk_score(factors: DataFrame, by: str, severity: str, confidence: str) -> DataFrame:
    """(by, score, level): mean severity (3, 2, 1) weighted by confidence, to two places; 0 without confidence."""
    value = F.when(F.col(severity) == "high", 3).when(F.col(severity) == "medium", 2).when(F.col(severity) == "low", 1).otherwise(0)
    found = factors.groupBy(by).agg(F.sum(value * F.col(confidence)).alias("s"), F.sum(confidence).alias("c"))
    score = F.floor(F.coalesce(F.try_divide(F.col("s"), F.col("c")), F.lit(0.0)) * 100 + 0.5) / 100
    return found.select(by, score.alias("score"), risk_level(score).alias("level"))


def risk_level(score: Column) -> Column:
    return F.when(score >= 2.5, "critical").when(score >= 1.8, "high").when(score >= 1.2, "medium").otherwise("low")
