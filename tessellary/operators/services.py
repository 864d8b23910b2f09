"""Rules, permissions, plans and reminders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def most_specific(pairs: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` (keys, src, dst) with allowed, by rules (rule_src, rule_dst, allowed) that may hold *; exact, then source, then target, then any.

    No rule means not allowed. Rules are a dimension of bounded size and are broadcast.
    """
    fits = (F.col("rule_src").isin("*") | (F.col("rule_src") == F.col("src"))) & (F.col("rule_dst").isin("*") | (F.col("rule_dst") == F.col("dst")))
    rank = F.when(F.col("rule_src") != "*", 0).otherwise(2) + F.when(F.col("rule_dst") != "*", 0).otherwise(1)
    met = pairs.join(F.broadcast(rules), fits, "left")
    best = met.groupBy(*keys, "src", "dst").agg(F.min(F.struct(rank.alias("r"), "allowed")).alias("b"))
    return best.select(*keys, "src", "dst", F.coalesce("b.allowed", F.lit(False)).alias("allowed"))


def permitted(pages: DataFrame, acl: DataFrame, roles: DataFrame, users: DataFrame, wanted: str) -> DataFrame:
    """(user, page): pages for which a user has a permission; a row of the page's own list overrides the role's."""
    default = users.join(F.broadcast(roles), "role").select("user", "permissions")
    both = pages.join(default).join(acl.select("user", "page", F.col("permissions").alias("own")), ["user", "page"], "left")
    return both.where(F.array_contains(F.coalesce("own", "permissions"), wanted)).select("user", "page")


def batches(rows: DataFrame, by: list[str], order: list, size: int) -> DataFrame:  # noqa: ANN001
    """``rows`` with batch, the number of the chunk of ``size`` they fall in within their key, and the batch it waits for."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    batch = F.floor(at / size).cast("int")
    return rows.withColumn("batch", batch).withColumn("waits_for", F.when(F.col("batch") > 0, F.col("batch") - 1))


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Rows of two interval tables (key, a_start, a_end) and (key, b_start, b_end) that overlap, ends included.

    An interval's level is the least whose blocks, of ``width`` times 2^level, are as long as it is, so it lies in two of them at most, at its own level and above.
    A pair meets at the larger of both levels, in the block where the later one begins; so rows grow with the intervals' number and the levels of their key, never with their length.
    """
    level = lambda lo, hi: F.greatest(F.lit(0), F.ceil(F.log2((F.abs(F.col(hi) - F.col(lo)) + 1) / width))).cast("int")
    block = lambda x: F.floor(x / (width * F.pow(F.lit(2.0), F.col("__level"))))
    x, y = a.withColumn("__a", level("a_start", "a_end")), b.withColumn("__b", level("b_start", "b_end"))
    of_a, of_b = (df.groupBy(F.col(key).alias("__key")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c))).alias("__mask")) for df, c in ((x, "__a"), (y, "__b")))
    held = F.filter(F.array(*(F.lit(v) for v in range(63))), lambda v: F.call_function("shiftright", F.col("__mask"), v) % 2 != 0)

    def placed(df: DataFrame, own: str, others: DataFrame) -> DataFrame:
        above = F.filter("__levels", lambda v: v > F.col(own))
        levels = F.when(F.array_min("__levels") <= F.col(own), F.concat(F.array(own), above)).otherwise(above)
        met = df.join(others.select("__key", held.alias("__levels")), F.col(key) == F.col("__key")).withColumn("__level", F.explode(levels)).drop("__key", "__levels")
        ends = [F.col(f"{own[2:]}_{e}") for e in ("start", "end")]
        return met.withColumn("__block", F.explode(F.sequence(block(F.least(*ends)), block(F.greatest(*ends)))))

    met = placed(x, "__a", of_b).join(placed(y, "__b", of_a), [key, "__level", "__block"]).where((F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")))
    met = met.where((F.col("__level") == F.greatest("__a", "__b")) & (F.col("__block") == block(F.greatest("a_start", "b_start"))))
    return met.drop("__block", "__level", "__a", "__b")


def ancestors(path: Column) -> Column:
    """All leading parts of a path, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def outdated_score(days: Column, changes: Column) -> Column:
    """Half for age up to 90 days and half for up to 20 changes."""
    part = lambda x, most: F.least(x / most, F.lit(1.0)) * 0.5
    return part(days, 90.0) + part(changes, 20.0)


def sync_health(high: Column, medium: Column, total: Column) -> Column:
    return F.greatest(F.lit(0), 100 - high * 20 - medium * 10 - total * 5)


def strategy(changes: Column, pages: Column) -> Column:
    """full over 100 changes or 50 pages, incremental over 20 or 10, else selective."""
    return F.when((changes > 100) | (pages > 50), "full").when((changes > 20) | (pages > 10), "incremental").otherwise("selective")


def filled_forward(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Null values take the last one before them in order."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def parents(rows: DataFrame, by: str, order: str, level: str, most: int = 6) -> DataFrame:
    """``rows`` with parent, the order of the nearest earlier row of a smaller level (1 to ``most``); null at the top; rows of equal order aren't before each other."""
    w = Window.partitionBy(by).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    out = rows
    for k in range(1, most):
        out = out.withColumn(f"__{k}", F.max(F.when(F.col(level) <= k, F.col(order))).over(w))
    choice = F.lit(None)
    for k in range(2, most + 1):
        choice = F.when(F.col(level) == k, F.col(f"__{k - 1}")).otherwise(choice)
    return out.withColumn("parent", choice).drop(*(f"__{k}" for k in range(1, most)))
