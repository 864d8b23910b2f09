"""Logs, versions and caches that outlive a session: append-only folders, cut so that a reader opens only what it asks for."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


class Store:
    """A folder of rows (``schema``) by ``keys``, of which the last one saved counts; ``part`` is the expression that cuts it, named ``cut``.

    Every save adds files under the cut's values and its own number, so none is rewritten; a save that broke off leaves no file, and rows that
    were saved twice count once. Conditions on the cut prune folders, conditions on columns reach the files.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], part: Column) -> None:
        self.spark, self.folder, self.schema, self.keys, self.part = spark, folder, schema, keys, part

    def save(self, rows: DataFrame) -> None:
        """Add rows; extra columns are left out. Each cut's rows are written by one task a cut and task of the input at most."""
        kept = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))
        kept.withColumns({"cut": self.part, "save": F.lit(time.time_ns())}).write.mode("append").partitionBy("cut", "save").parquet(self.folder)

    def files(self) -> DataFrame:
        """All rows with cut and save, those that later saves replace included; none if nothing was ever saved."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        full = StructType([*self.schema.fields, *StructType().add("cut", "string").add("save", LongType()).fields])
        return self.spark.read.schema(full).parquet(self.folder) if there else self.spark.createDataFrame([], full)

    def load(self, where: Column | None = None) -> DataFrame:
        """The last saved row of each key among those that meet ``where``, a condition on keys and the cut only, as it comes before the choice."""
        rows = self.files() if where is None else self.files().where(where)
        last = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("save")))
        return rows.withColumn("__r", last).where("__r = 1").select(*(f.name for f in self.schema))


def log_store(spark: SparkSession, folder: str, schema: StructType, key: str, at: str) -> Store:
    """A log cut by month."""
    return Store(spark, folder, schema, [key], F.date_format(at, "yyyy-MM"))


def logged(store: Store, at: str, start: object = None, end: object = None) -> DataFrame:
    """Entries from ``start`` to ``end``, both included, newest first; only their months' files are opened."""
    where = F.lit(True)
    if start is not None:
        where &= (F.col("cut") >= F.date_format(F.lit(start), "yyyy-MM")) & (F.col(at) >= F.lit(start))
    if end is not None:
        where &= (F.col("cut") <= F.date_format(F.lit(end), "yyyy-MM")) & (F.col(at) <= F.lit(end))
    return store.load(where).orderBy(F.desc(at), *store.keys)


def version_store(spark: SparkSession, folder: str, schema: StructType, page: str, version: str, cuts: int = 64) -> Store:
    """Versions of pages, cut by a hash of the page."""
    return Store(spark, folder, schema, [page, version], F.pmod(F.xxhash64(page), F.lit(cuts)).cast("string"))


def versions_of(store: Store, ids: DataFrame | list, newest: int | None = None, skip: int = 0) -> DataFrame:
    """Versions of the asked pages, the greatest first: ``newest`` of each, after ``skip``. A few ids given as a list open their cuts only."""
    page, version = store.keys
    if isinstance(ids, list):
        kind = store.schema[page].dataType
        cuts = [r.cut for r in store.spark.createDataFrame([(i,) for i in ids], StructType().add(page, kind)).select(store.part.alias("cut")).distinct().collect()]
        found = store.load(F.col("cut").isin(cuts) & F.col(page).isin(ids))
    else:
        found = store.load().join(ids.select(page).distinct(), page, "left_semi")
    rank = F.row_number().over(Window.partitionBy(page).orderBy(F.desc(version)))
    last = F.lit(True) if newest is None else F.col("__n") <= skip + newest
    return found.withColumn("__n", rank).where((F.col("__n") > skip) & last).drop("__n")


def cache_store(spark: SparkSession, folder: str, schema: StructType, key: str, cuts: int = 64) -> Store:
    """Cached values, hashes or vectors by key."""
    return Store(spark, folder, schema, [key], F.pmod(F.xxhash64(key), F.lit(cuts)).cast("string"))


def unchanged(store: Store, current: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of ``current`` whose value is the cached one; null equals null."""
    old = store.load().select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return current.join(old, (F.col(key) == F.col("__k")) & F.col(value).eqNullSafe(F.col("__v")), "left_semi")
