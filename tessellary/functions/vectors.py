"""Functions on vectors (arrays of numbers), as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row: a lambda's body would compute it anew for each element."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different length and for zero vectors."""
    value = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(F.size(a) == F.size(b), F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    scaled = lambda v, n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>"))
    return once(a, lambda v: once(norm(v), lambda n: scaled(v, n)))


def hashed_embedding(text: Column, dim: int) -> Column:
    """A deterministic unit vector of a text: sines of successive 32-bit windows of its SHA-256."""

    def waves(digest: Column) -> Column:
        window = lambda i: F.conv(F.substring(digest, F.pmod(i, F.lit(57)) + 1, F.lit(8)), 16, 10).cast("double")
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.sin(window(i)) * 0.5)

    return unit(once(F.sha2(text.cast("binary"), 256), waves))
