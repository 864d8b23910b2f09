"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label are one class first, so that copies don't fill the windows. Each pass hashes every class's vector by signs of
random projections, orders all of a label by the concatenated bits and compares each with the next ``window`` ones; pairs that reach the
cosine are joined, over all passes. What windows leave out within a component is then compared in blocks, so links are counted in full there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, Scratch, components, runs, whole_runs

PASSES, AT_ONCE, WINDOW, BITS = 24, 8, 24, 62
#: Rows of one task of a pass, rows of one block of a component, and rows of a block that are compared at once.
ROWS, BLOCK, STRIP = 20_000, 4096, 512


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Unit rows, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def usable(vectors: DataFrame, vec: str, label: str) -> DataFrame:
    """Rows whose vector has only finite components, not all zero, and a label. Vectors keep their precision; cosines are in double precision."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(label).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def _keys(rows: DataFrame, passes: list[int], seed: int) -> DataFrame:
    """A row for each pass: pass, label, dim, rid, vec and key, the pass's bits as a long."""

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = np.int64(1) << np.arange(BITS, dtype=np.int64)[::-1]
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part["vec"], int(dim))
                for p in passes:
                    if (p, dim) not in planes:
                        planes[p, dim] = np.random.default_rng([seed, p, int(dim)]).standard_normal((int(dim), BITS))
                    key = ((x @ planes[p, dim]) > 0) @ weights
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), p, np.int32)), part["label"], part["dim"], part["rid"], part["vec"], pa.array(key)],
                        ["pass", "label", "dim", "rid", "vec", "key"],
                    )

    types = {c: rows.schema[c].dataType.simpleString() for c in ("label", "vec")}
    return rows.select("label", "dim", "rid", "vec").mapInArrow(
        on_partition, f"pass int, label {types['label']}, dim int, rid bigint, vec {types['vec']}, key bigint"
    )


def _near(x: np.ndarray, group: np.ndarray, window: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs at most ``window`` apart in one group whose cosine is reached."""
    a, b = [], []
    for gap in range(1, min(window, len(x) - 1) + 1):
        hit = np.flatnonzero((np.einsum("ij,ij->i", x[:-gap], x[gap:]) >= cosine) & (group[:-gap] == group[gap:]))
        a.append(hit)
        b.append(hit + gap)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


_OUT = "kind int, a bigint, b bigint, part int, at int, grp bigint, dim int, vec "


def _compare(tables: Iterator[pa.Table], window: int, cosine: float, rims: bool, vec: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Edges (kind 0) within a sorted partition, and its first and last ``window`` rows (kind 1 and 2) for its neighbours.

    ``grp`` numbers pass, label and dim; edges are a forest of each table's pairs.
    """
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("at", pa.int32()), ("grp", pa.int64()), ("dim", pa.int32()), ("vec", vec)])

    def rim(t: pa.Table, kind: int, place: int) -> pa.RecordBatch:
        n = t.num_rows
        cols = {"kind": pa.array([kind] * n, pa.int32()), "a": t["rid"], "b": pa.nulls(n, pa.int64()), "part": t["part"], "at": pa.array(range(place, place + n), pa.int32()), "grp": t["grp"], "dim": t["dim"], "vec": t["vec"]}
        return pa.table(cols).cast(schema).combine_chunks().to_batches()[0]

    held: pa.Table | None = None
    for table in tables:
        if not table.num_rows:
            continue
        if held is None and rims:
            yield rim(table.slice(0, window), 1, 0)
        both = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        rid, group, dims = both["rid"].to_numpy(), both["grp"].to_numpy(), both["dim"].to_numpy()
        forest = Forest(len(rid))
        starts = runs([dims])
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            x = _matrix(both["vec"].slice(low, high - low), int(dims[low]))
            a, b = _near(x, group[low:high], window, cosine)
            forest.union(a + low, b + low)
        root = forest.flat()
        own = np.flatnonzero(root != np.arange(len(root)))
        if len(own):
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), pa.array(rid[own]), pa.array(rid[root[own]]), *(pa.nulls(n, schema.field(i).type) for i in range(3, 8))], schema=schema
            )
        held = both.slice(max(0, both.num_rows - window)).combine_chunks()
    if held is not None and rims:
        yield rim(held, 2, 0)


def _pass_edges(rows: DataFrame, passes: list[int], parts: int, scratch: Scratch, window: int, cosine: float, seed: int) -> DataFrame:
    """(a, b) found in some passes: one sort by range; windows that reach over a border of two tasks are compared by themselves."""
    keyed = _keys(rows, passes, seed).withColumn("grp", F.xxhash64("pass", "label", "dim"))
    order = ["grp", "key", "rid"]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    given = rows.schema["vec"].dataType.simpleString()
    vec = pa.list_(pa.float32() if given == "array<float>" else pa.float64())

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare((pa.Table.from_batches([b]) for b in batches), window, cosine, True, vec)

    found = scratch.keep(dealt.select("rid", "grp", "dim", "vec", "part").mapInArrow(within, _OUT + given), "passes")
    # the borders: a partition's last rows and the next one's first, 2 * window rows at most
    heads = found.where("kind = 1").withColumn("part", F.col("part") - 1)
    rims = found.where("kind = 2").unionByName(heads).select(F.col("a").alias("rid"), "grp", "dim", "vec", "part", "kind", "at")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["part"], 4096):
            starts = runs([table["part"].to_numpy()])
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                yield from _compare(iter([table.slice(low, high - low).combine_chunks()]), window, cosine, False, vec)

    met = rims.repartition("part").sortWithinPartitions("part", F.desc("kind"), "at").mapInArrow(across, _OUT + given)
    return found.where("kind = 0").select("a", "b").unionByName(met.select("a", "b"))


def _link_counts(members: DataFrame, cosine: float) -> DataFrame:
    """(rid, n): links of members (root, rid, dim, vec, size) to the rows of other members of their component, by pairs of blocks of about BLOCK members."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK)
    placed = members.join(sizes, "root").select("root", "rid", "dim", "vec", "size", blocks.alias("blocks"), F.pmod(F.xxhash64("rid"), blocks).alias("own"))
    # a block meets itself and every other; the pair of blocks i < j is one group
    met = placed.select("root", "rid", "dim", "vec", "size", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    met = met.select("rid", "dim", "vec", "size", "own", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("pair"))

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["pair"], 65_536):
            starts = runs([table["pair"].to_numpy()])
            rid, own, dims, weight = (table[c].to_numpy() for c in ("rid", "own", "dim", "size"))
            count = np.zeros(len(rid), np.int64)
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                x = _matrix(table["vec"].slice(low, high - low), int(dims[low]))
                side, rows = own[low:high], weight[low:high]
                for at in range(0, len(x), STRIP):
                    near = x[at : at + STRIP] @ x.T >= cosine
                    if side[0] != side[-1]:  # two blocks: each row counts the other block's only
                        near &= side[at : at + STRIP, None] != side[None, :]
                    else:
                        near[np.arange(len(near)), np.arange(at, at + len(near))] = False
                    count[low + at : low + at + len(near)] = near @ rows
            has = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(rid[has]), pa.array(count[has])], ["rid", "n"])

    dealt = met.repartition("pair").sortWithinPartitions("pair", "own")
    return dealt.mapInArrow(on_partition, "rid bigint, n bigint").groupBy("rid").agg(F.sum("n").alias("n"))


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.98, passes: int = PASSES, window: int = WINDOW, seed: int = 7,
    vec_id: str = "vec_id", vec: str = "embedding", label: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows are vertices of their own even if a vec_id repeats. A vector that is null, empty, zero or holds null or non-finite components, or whose
    label is null, links with nothing, nor do vectors of different length; a null vec_id is never a component_id unless all are.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("vec"), F.col(label).alias("label"))
    rows = scratch.keep(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    good = usable(rows, "vec", "label").withColumn("dim", F.size("vec")).select("rid", "vec_id", "label", "dim", "vec", F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("g"))
    # classes of equal vectors, each named by its least rid
    same = ["label", "dim", "h", "g"]
    classes = good.groupBy(*same).agg(F.min("rid").alias("rid"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"), F.any_value("vec").alias("vec"))
    classes = scratch.keep(classes, "classes")
    n = classes.count()
    edges: DataFrame | None = None
    for low in range(0, passes, AT_ONCE):
        some = list(range(low, min(passes, low + AT_ONCE)))
        parts = max(1, -(-n * len(some) // ROWS))
        found = scratch.keep(_pass_edges(classes, some, parts, scratch, window, cosine, seed).distinct(), "edges")
        edges = found if edges is None else edges.unionByName(found)
    roots = components(scratch, edges).withColumnRenamed("v", "rid")
    members = scratch.keep(classes.join(roots, "rid").select("root", "rid", "dim", "vec", "size", "least"), "members")
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    of = members.select("rid", "root").join(least, "root").join(_link_counts(members, cosine), "rid", "left")
    of = scratch.keep(of.select(F.col("rid").alias("class"), "component_id", F.coalesce("n", F.lit(0)).alias("n")), "links")
    linked = classes.select(*same, F.col("rid").alias("class"), "least", "size").join(of, "class", "left")
    linked = linked.select(*same, F.coalesce("component_id", "least").alias("component_id"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    linked = scratch.keep(linked.where("n_links > 0"), "linked")
    # vectors that link with nothing are named by themselves; the others find their class, a hot one's rows by as many tasks as need be
    found = good.select("rid", *same).join(linked, same).select("rid", "component_id", "n_links")
    out = rows.select("rid", "vec_id").join(found, "rid", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
