"""Shortest edit scripts of line sequences by Myers' greedy method, in linear space, and tables of the changes.

A pair that needs few edits is solved by one forward search, whose choices fix which of several shortest scripts is taken. Others are
divided at the middle snake, where a forward and a backward search meet; each search keeps one number a diagonal and
moves all diagonals at once. Texts of many lines may be cut at anchors first, so that several tasks share them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edits up to which the forward search keeps its steps: at most its square / 2 numbers of 4 bytes.
TRACED = 1_000

Edit = tuple[str, int, int]


def _advance(reach: np.ndarray, d: int, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray]:
    """Step d of a search: the lowest diagonal and how far into ``a`` each second diagonal from it on gets, -1 where it left the grid."""
    n, m, zero = len(a), len(b), len(b) + 1  # reach[zero + k] is that of diagonal k
    low, high = max(-d, -m + (m + d) % 2), min(d, n - (n + d) % 2)
    k = np.arange(low, high + 1, 2)
    if d:
        left, up = reach[zero + low - 1 : zero + high : 2], reach[zero + low + 1 : zero + high + 2 : 2]
        x = np.maximum(np.where((left >= 0) & (left < n), left + 1, -1), np.where(up - k <= m, up, -1))
    else:
        x = np.zeros(1, np.int64)
    y = x - k
    live = np.flatnonzero((x >= 0) & (x < n) & (y < m))
    while len(live):
        live = live[a[x[live]] == b[x[live] - k[live]]]
        x[live] += 1
        live = live[(x[live] < n) & (x[live] - k[live] < m)]
    reach[zero + low : zero + high + 1 : 2] = x
    return low, x


def _traced(a: np.ndarray, b: np.ndarray, most: int) -> list[Edit] | None:
    """The script that the forward search finds, deletions preferred at equal reach; None if it needs over ``most`` edits."""
    n, m = len(a), len(b)
    reach, zero = np.full(n + m + 3, -1, np.int64), m + 1
    steps: list[tuple[int, np.ndarray]] = []
    for d in range(min(most, n + m) + 1):
        low, x = _advance(reach, d, a, b)
        steps.append((low, x.astype(np.int32)))
        if reach[zero + n - m] == n:
            break
    else:
        return None
    out: list[Edit] = []
    x, y = n, m
    for d in range(len(steps) - 1, 0, -1):
        low, before = steps[d - 1]
        at = lambda k, low=low, before=before: int(before[(k - low) // 2]) if 0 <= k - low < 2 * len(before) else -1
        k = x - y
        left, up = at(k - 1), at(k + 1)
        down = up >= 0 and up - k <= m and (left < 0 or left >= n or left < up)
        start = up if down else left + 1
        while x > start:
            x, y = x - 1, y - 1
            out.append(("equal", x, y))
        if down:
            y -= 1
            out.append(("insert", x, y))
        else:
            x -= 1
            out.append(("delete", x, y))
    out += [("equal", i, i) for i in range(x - 1, -1, -1)]
    return out[::-1]


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """A point of a shortest path where a search from the start and one from the end meet. Their first and last lines differ."""
    n, m = len(a), len(b)
    back_a, back_b = a[::-1], b[::-1]
    front, back, zero = np.full(n + m + 3, -1, np.int64), np.full(n + m + 3, -1, np.int64), m + 1
    delta = n - m

    def met(low: int, x: np.ndarray, other: np.ndarray) -> int:
        """Place in ``x`` of a diagonal on which the two searches have covered all of ``a``, or -1."""
        facing = delta - low - 2 * np.arange(len(x))
        there = other[np.clip(zero + facing, 0, len(other) - 1)]
        hit = np.flatnonzero((x >= 0) & (there >= 0) & (x + there >= n) & (facing >= -m) & (facing <= n))
        return int(hit[0]) if len(hit) else -1

    for d in range((n + m + 1) // 2 + 1):
        low, x = _advance(front, d, a, b)
        if delta % 2 and (i := met(low, x, back)) >= 0:
            return int(x[i]), int(x[i]) - low - 2 * i
        low, x = _advance(back, d, back_a, back_b)
        if not delta % 2 and (i := met(low, x, front)) >= 0:
            return n - int(x[i]), m - (int(x[i]) - low - 2 * i)
    raise AssertionError("two searches must meet")


def _divided(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Kept lines of a shortest script, as places in both, in order; memory in proportion to the lines."""
    todo: list[tuple[int, int, int, int] | tuple[int, int]] = [(0, len(a), 0, len(b))]
    while todo:
        part = todo.pop()
        if len(part) == 2:
            yield part
            continue
        i, i_end, j, j_end = part
        while i < i_end and j < j_end and a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
        tail = 0
        while i < i_end - tail and j < j_end - tail and a[i_end - 1 - tail] == b[j_end - 1 - tail]:
            tail += 1
        todo.extend((i_end - t, j_end - t) for t in range(1, tail + 1))
        i_end, j_end = i_end - tail, j_end - tail
        if i == i_end or j == j_end:
            continue
        if i_end - i + j_end - j <= TRACED:
            yield from ((i + x, j + y) for kind, x, y in _traced(a[i:i_end], b[j:j_end], TRACED) if kind == "equal")
            continue
        x, y = _middle(a[i:i_end], b[j:j_end])
        todo += [(i + x, i_end, j + y, j_end), (i, i + x, j, j + y)]


def shortest_script(a: list[str], b: list[str]) -> list[Edit]:
    """A shortest edit script as (equal | delete | insert, line in a, line in b).

    With at most TRACED edits it is that of the forward search. With more, lines that only one side has are set aside (no script can
    keep them) and the rest is divided; between kept lines deletions come first. Time is in proportion to lines times edits.
    """
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(line, len(ids)) for line in lines], np.int64) for lines in (a, b))
    if (found := _traced(x, y, TRACED)) is not None:
        return found
    at_x, at_y = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    out: list[Edit] = []
    i = j = 0
    for p, q in [*((int(at_x[p]), int(at_y[q])) for p, q in _divided(x[at_x], y[at_y])), (len(a), len(b))]:
        out += [("delete", k, j) for k in range(i, p)]
        out += [("insert", p, k) for k in range(j, q)]
        if p < len(a) and q < len(b):
            out.append(("equal", p, q))
        i, j = p + 1, q + 1
    return out


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of lines that each side has just once, as a longest chain that rises in both."""

    def once(lines: list[str]) -> dict[str, int]:
        seen: dict[str, int] = {}
        for i, line in enumerate(lines):
            seen[line] = -1 if line in seen else i
        return {line: i for line, i in seen.items() if i >= 0}

    there = once(b)
    pairs = [(i, there[line]) for line, i in once(a).items() if line in there]  # in the order of a
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for p, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[p] = last[at - 1] if at else -1
        tails[at:], last[at:] = ([j], [p]) if at == len(tails) else ([j, *tails[at + 1 :]], [p, *last[at + 1 :]])
    chain, p = [], last[-1] if last else -1
    while p >= 0:
        chain.append(pairs[p])
        p = before[p]
    return chain[::-1]


def _lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def _cut(a: list[str], b: list[str], most: int) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """Parts of about ``most`` lines between anchors, with the places where they begin."""
    i = j = 0
    for p, q in anchors(a, b):
        if p - i + q - j >= most:
            yield i, j, a[i:p], b[j:q]
            i, j = p, q
    yield i, j, a[i:], b[j:]


def changes(pairs: DataFrame, key: str, old: str, new: str, anchored_over: int | None = None) -> DataFrame:
    """(key, type, old_line, new_line, content): a row for each removed or added line of a shortest script, lines from 1 on.

    A removed line has no new_line and an added one no old_line; (new_line, old_line) of neighbours order a script: ``place`` counts its lines.
    Null and empty texts have no lines. With ``anchored_over``, pairs of more lines together are cut where both texts have the
    same unique line, dealt out part by part, and their scripts are then valid but not always shortest.
    """
    kind = pairs.schema[key].dataType.simpleString()
    parts = ["key", "part", "old_from", "new_from", "a", "b"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (_lines(batch.column(c)[row].as_py()) for c in (1, 2))
                found = [(0, 0, a, b)] if anchored_over is None or len(a) + len(b) <= anchored_over else list(_cut(a, b, anchored_over))
                for n, (i, j, x, y) in enumerate(found):
                    lists = [pa.array([v], t) for v, t in ((n, pa.int32()), (i, pa.int32()), (j, pa.int32()), (x, pa.list_(pa.string())), (y, pa.list_(pa.string())))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), *lists], parts)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, i, j, a, b = (batch.column(c)[row].as_py() for c in range(1, 6))
                script = [(n, *e) for n, e in enumerate(shortest_script(a, b)) if e[0] != "equal"]
                columns = [
                    pa.array([part] * len(script), pa.int32()), pa.array([n for n, *_ in script], pa.int32()),
                    pa.array(["removed" if k == "delete" else "added" for _, k, _, _ in script], pa.string()),
                    pa.array([i + x + 1 if k == "delete" else None for _, k, x, _ in script], pa.int32()),
                    pa.array([j + y + 1 if k == "insert" else None for _, k, _, y in script], pa.int32()),
                    pa.array([a[x] if k == "delete" else b[y] for _, k, x, y in script], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(script), pa.int64())), *columns], names)

    names = ["key", "part", "place", "type", "old_line", "new_line", "content"]
    pieces = pairs.select(F.col(key).alias("key"), F.col(old), F.col(new)).mapInArrow(cut, f"key {kind}, part int, old_from int, new_from int, a array<string>, b array<string>")
    if anchored_over is not None:
        pieces = pieces.repartition("key", "part")
    found = pieces.mapInArrow(edits, f"key {kind}, part int, place int, type string, old_line int, new_line int, content string")
    return found.select(F.col("key").alias(key), "part", "place", "type", "old_line", "new_line", "content")


def _line() -> Column:
    return F.coalesce("old_line", "new_line")


def hunks(changed: DataFrame, key: str, context: int = 3) -> DataFrame:
    """(key, hunk, start, old_count, new_count, lines) of ``changes``: a hunk ends where the next change's own line is over 2 x ``context`` on.

    Lines are counted in the text that a change is of; ``lines`` are the hunk's changes in order, marked - and +.
    """
    order = Window.partitionBy(key).orderBy("part", "place")
    begins = F.coalesce(_line() - F.lag(_line()).over(order) > 2 * context, F.lit(True)).cast("int")
    rows = changed.withColumn("begins", begins)
    rows = rows.withColumn("hunk", F.sum("begins").over(order))
    marked = F.concat(F.when(F.col("type") == "added", "+").otherwise("-"), "content")
    first = F.min_by(_line(), F.struct("part", "place"))
    count = lambda kind: F.count_if(F.col("type") == kind)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "place", marked.alias("line")))), lambda x: x["line"])
    return rows.groupBy(key, "hunk").agg(first.alias("start"), count("removed").alias("old_count"), count("added").alias("new_count"), lines.alias("lines"))


def unified_texts(found: DataFrame, key: str) -> DataFrame:
    """(key, diff): the hunks of each pair one after the other, each under its @@ line."""
    head = F.format_string("@@ -%d,%d +%d,%d @@", "start", "old_count", "start", "new_count")
    text = F.concat_ws("\n", head, "lines")
    parts = F.array_sort(F.collect_list(F.struct("hunk", text.alias("text"))))
    return found.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("diff"))


def html_rows(changed: DataFrame) -> DataFrame:
    """``changed`` with ``html``, each change as a table row: its line numbers, its mark and the escaped line."""
    escaped = F.col("content")
    # What stands for the characters that HTML reserves.
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(name))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    mark = F.when(F.col("type") == "added", "+").otherwise("-")
    cells = F.format_string(
        '<tr class="diff-%s"><td class="line-num old">%s</td><td class="line-num new">%s</td><td class="line-content"><span class="diff-marker">%s</span>%s</td></tr>',
        "type", number("old_line"), number("new_line"), mark, escaped,
    )
    return changed.withColumn("html", cells)


def counts(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, additions, deletions, similarity) of every pair; similarity is common lines over the lines of the longer text, 1 for two empty ones."""
    changed = changes(pairs, key, old, new).groupBy(key).agg(F.count_if(F.col("type") == "added").alias("additions"), F.count_if(F.col("type") == "removed").alias("deletions"))
    size = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", 0).otherwise(F.size(F.split(c, "\n", -1)))
    sizes = pairs.select(key, size(old).alias("n"), size(new).alias("m"))
    joined = sizes.join(changed, key, "left").fillna(0, ["additions", "deletions"])
    most = F.greatest("n", "m")
    similarity = F.when(most == 0, 1.0).otherwise((F.col("n") - F.col("deletions")) / most).alias("similarity")
    return joined.select(key, "additions", "deletions", similarity)
