"""User-defined aggregates: states made in the map tasks, merged after a shuffle by key."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups whose states a map task holds before it hands them on, and tables of states that the first merge of a key takes in.
HELD, FAN = 50_000, 64


@dataclass(frozen=True)
class Aggregate:
    """An aggregate of one column: ``add`` takes a state and an array of values without nulls, ``merge`` two states in any order, ``finish`` gives the result.

    States must pickle and stay small, as one stands for any number of rows; ``kind`` is the result's SQL type. A group without values finishes ``zero()``.
    """

    column: str
    kind: str
    zero: Callable[[], Any]
    add: Callable[[Any, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]


def aggregated(df: DataFrame, keys: list[str], aggregates: dict[str, Aggregate]) -> DataFrame:
    """``keys`` and each aggregate's result for every group; null keys are a group of their own, as in a groupBy, and no rows give no groups.

    Each task folds its rows into one state a group, which is all that is shuffled: first by key and ``FAN`` tables, then by key, so
    that a group met by every task is merged in parts. Both merges stream rows sorted by key.
    """
    names = list(aggregates)
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    columns = sorted({a.column for a in aggregates.values()})
    states = ", ".join(["__part int", *(f"`__k{i}` {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)), "__states binary"])
    inner = [f"__k{i}" for i in range(len(keys))]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, types = TaskContext.get().partitionId(), {}, []
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(keys))]
            table = pa.Table.from_batches([batch])
            order = table.select(inner).append_column("row", pa.array(np.arange(len(table)))).group_by(inner, use_threads=False).aggregate([("row", "list")]) if keys else None
            groups = zip(zip(*(order[k].to_pylist() for k in inner), strict=True), order["row_list"], strict=True) if keys else [((), None)]
            for key, rows in groups:
                state = held.get(key) or [aggregates[n].zero() for n in names]
                chosen = batch if rows is None else batch.take(rows.values)
                values = {c: chosen.column(len(keys) + i).drop_null().to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}
                held[key] = [aggregates[n].add(s, values[aggregates[n].column]) for n, s in zip(names, state, strict=True)]
            if len(held) > HELD:
                yield packed(part, held, types)
                held = {}
        if held:
            yield packed(part, held, types)

    def packed(part: int, held: dict[tuple, list], types: list[pa.DataType]) -> pa.RecordBatch:
        columns_ = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int32()), *columns_, pa.array(map(pickle.dumps, held.values()), pa.binary())], ["__part", *inner, "__states"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list, list[pa.DataType]]]:
        """(key, states) of each run of equal keys."""
        key, state, types = None, None, []
        for batch in batches:
            types = [batch.schema.field(i + 1).type for i in range(len(keys))]
            for *k, raw in zip(*(batch.column(i + 1).to_pylist() for i in range(len(keys) + 1)), strict=True):
                more = pickle.loads(raw)  # noqa: S301 - made by the tasks of this job
                if state is not None and tuple(k) == key:
                    state = [aggregates[n].merge(a, b) for n, a, b in zip(names, state, more, strict=True)]
                    continue
                if state is not None:
                    yield key, state, types
                key, state = tuple(k), more
        if state is not None:
            yield key, state, types

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, state, types in merged(batches):
            yield packed(0, {key: state}, types)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, state, types in merged(batches):
            results = [pa.array([aggregates[n].finish(s)]) for n, s in zip(names, state, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types, strict=True)), *(r.cast(t) for r, t in zip(results, wanted, strict=True))], [*keys, *names])

    spark_types = df.sparkSession.createDataFrame([], ", ".join(f"`{n}` {a.kind}" for n, a in aggregates.items())).schema
    from pyspark.sql.pandas.types import to_arrow_type

    wanted = [to_arrow_type(f.dataType) for f in spark_types]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, inner, strict=True)), *(F.col(c) for c in columns))
    parts = rows.mapInArrow(folded, states).withColumn("__part", F.floor(F.col("__part") / FAN).cast("int"))
    once = parts.repartition("__part", *inner).sortWithinPartitions("__part", *inner).mapInArrow(again, states)
    dealt = (once.repartition(*inner) if keys else once.coalesce(1)).sortWithinPartitions(*(inner or ["__part"]))
    return dealt.mapInArrow(finished, ", ".join([*kinds, *(f"`{n}` {a.kind}" for n, a in aggregates.items())]))


def variance(column: str) -> Aggregate:
    """Population variance by counts, means and sums of squared deviations, which merge without loss; null of no values."""

    def merge(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        if not n:
            return a
        apart = b[1] - a[1]
        return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n

    def add(state: tuple, x: np.ndarray) -> tuple:
        x = x.astype(np.float64)
        return merge(state, (len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum()))) if len(x) else state

    return Aggregate(column, "double", lambda: (0, 0.0, 0.0), add, merge, lambda s: s[2] / s[0] if s[0] else None)


def geometric_mean(column: str) -> Aggregate:
    """The geometric mean of values over 0; null of no values."""
    add = lambda s, x: (s[0] + len(x), s[1] + float(np.log(x.astype(np.float64)).sum()))
    return Aggregate(column, "double", lambda: (0, 0.0), add, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: float(np.exp(s[1] / s[0])) if s[0] else None)


def top(column: str, k: int, kind: str = "array<bigint>") -> Aggregate:
    """The ``k`` greatest distinct values, greatest first."""
    cut = lambda x: sorted(set(x), reverse=True)[:k]
    return Aggregate(column, kind, list, lambda s, x: cut([*s, *x.tolist()]), lambda a, b: cut([*a, *b]), lambda s: s)
