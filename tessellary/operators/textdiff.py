"""Line differences of text pairs; the edit script needs an algorithm, so these run on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linediff import shortest_script


def lines_of(text: str | None) -> list[str]:
    """Lines of a text; an empty or null text has none."""
    return text.split("\n") if text else []


def similarity(a: str | None, b: str | None) -> float:
    """Common lines over the lines of the longer text; 1 for two empty texts."""
    x, y = lines_of(a), lines_of(b)
    if not x and not y:
        return 1.0
    return sum(kind == "equal" for kind, _, _ in shortest_script(x, y)) / max(len(x), len(y))


def unified(a: str | None, b: str | None, context: int = 3) -> str:
    """A unified diff; hunks part where more than twice the context is unchanged."""
    x, y = lines_of(a), lines_of(b)
    return unified_script(x, y, shortest_script(x, y), context)


def unified_script(x: list[str], y: list[str], script: list[tuple[str, int, int]], context: int = 3) -> str:
    """A unified diff of an edit script from ``x`` to ``y``."""
    changed = [i for i, (kind, _, _) in enumerate(script) if kind != "equal"]
    hunks: list[list[int]] = []
    for i in changed:
        if hunks and i - hunks[-1][1] <= 2 * context:
            hunks[-1][1] = i
        else:
            hunks.append([i, i])
    out = []
    for first, last in hunks:
        part = script[max(0, first - context) : last + context + 1]
        old, new = sum(k != "insert" for k, _, _ in part), sum(k != "delete" for k, _, _ in part)
        out.append(f"@@ -{part[0][1] + (old > 0)},{old} +{part[0][2] + (new > 0)},{new} @@")
        out += [f" {x[i]}" if k == "equal" else f"-{x[i]}" if k == "delete" else f"+{y[j]}" for k, i, j in part]
    return "\n".join(out)


def merge3(base: str, ours: str, theirs: str) -> tuple[str, bool]:
    """Three-way merge by lines, and whether both sides changed the same place differently (then both are kept, marked)."""
    x, a, b = lines_of(base), lines_of(ours), lines_of(theirs)
    to_a = {i: j for k, i, j in shortest_script(x, a) if k == "equal"}
    to_b = {i: j for k, i, j in shortest_script(x, b) if k == "equal"}
    out, conflict, i0, a0, b0 = [], False, 0, 0, 0
    for i in [*(i for i in range(len(x)) if i in to_a and i in to_b), len(x)]:
        a1, b1 = (to_a[i], to_b[i]) if i < len(x) else (len(a), len(b))
        old, left, right = x[i0:i], a[a0:a1], b[b0:b1]
        if left == right or right == old:
            out += left
        elif left == old:
            out += right
        else:
            conflict = True
            out += ["<<<<<<< ours", *left, "=======", *right, ">>>>>>> theirs"]
        if i < len(x):
            out.append(x[i])
        i0, a0, b0 = i + 1, a1 + 1, b1 + 1
    return "\n".join(out), conflict


def diff_stats(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, additions, deletions, similarity, diff) for each pair."""
    schema = f"`{key}` {pairs.schema[key].dataType.simpleString()}, additions int, deletions int, similarity double, diff string"

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x, y = lines_of(a), lines_of(b)
                script = shortest_script(x, y)
                kept = sum(k == "equal" for k, _, _ in script)
                out.append((len(y) - kept, len(x) - kept, kept / max(len(x), len(y)) if x or y else 1.0, unified_script(x, y, script)))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            types = (pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, types)], [key, "additions", "deletions", "similarity", "diff"])

    return pairs.select(key, F.col(old), F.col(new)).mapInArrow(on_partition, schema)
