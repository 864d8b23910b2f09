"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built on the driver. A text is
parsed against each automaton into longest phrases that occur in its sample (Ziv and Merhav's cross parsing);
the language that needs the fewest phrases for the text's length wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back

#: Bounds of the sample that a model learns from, for each language: distinct texts, code points taken of one of them, code points in all.
#: They bound the labelled rows that are fitted and nothing else; a model takes some 20 to 40 bytes for each code point of its samples.
DOCS, PER_DOC, CHARS = 128, 1000, 32_768
#: Code points that one lane parses, and lanes times code points that are parsed at once; neither changes a result.
SEGMENT, AT_ONCE = 256, 16_000_000
UNDETERMINED = "und"
#: Symbols of a character that no sample holds, and of what is behind a text's end.
_UNSEEN, _PAD = 0, 1
#: No code point; it stands between two samples.
_BREAK = 0x110000
_NONE, _LOW = -1, (1 << 32) - 1
#: Slots of the table for each transition, and transitions of a state that is placed by itself.
_SLOTS, _WIDE = 2.5, 8


class Moves:
    """Transitions (state, symbol) to state, all rows of states laid over each other in one array: the transition of a
    state by a symbol is at base[state] + symbol if the slot's owner is that state, else there is none."""

    def __init__(self, state: np.ndarray, symbol: np.ndarray, to: np.ndarray, states: int, width: int) -> None:
        """``state`` ascends and is below ``states``, ``symbol`` below ``width``."""
        rng = np.random.default_rng(1)
        size = max(16, int(_SLOTS * len(state)))
        degree = np.bincount(state, minlength=states)
        first = np.cumsum(degree) - degree
        self.base = np.zeros(len(degree), np.int64)
        owner = np.full(size + width, _NONE, np.int64)
        # wide rows first, one by one, then rows of the same width at random places, until none is left that another one's meets
        for s in sorted(np.flatnonzero(degree > _WIDE).tolist(), key=lambda s: (-degree[s], s)):
            row = symbol[first[s] : first[s] + degree[s]]
            while (owner[(at := rng.integers(size) + row)] != _NONE).any():
                pass
            owner[at], self.base[s] = s, at[0] - row[0]
        for d in range(_WIDE, 0, -1):
            left = np.flatnonzero(degree == d).astype(np.int32)
            while len(left):
                base = rng.integers(size, size=len(left))
                at = base[:, None] + symbol[first[left][:, None] + np.arange(d)]
                free = np.flatnonzero((owner[at] == _NONE).all(1))
                at, some, base = at[free], left[free], base[free]
                owner[at] = some[:, None]
                own = owner[at] == some[:, None]
                placed = own.all(1)
                owner[at[own & ~placed[:, None]]] = _NONE
                self.base[some[placed]] = base[placed]
                left = np.setdiff1d(left, some[placed], assume_unique=True)
        # owner and next state in one number, so that one look finds both
        self.slots = owner << 32
        self.slots[self.base[state] + symbol] |= to

    def __call__(self, base: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state for each pair, and whether there is none; ``base`` is that of each state."""
        found = self.slots.take(base + symbol)
        return found & _LOW, (found >> 32) != state


@dataclass
class Model:
    """Automata of all languages: the root of each one's and the transitions of all. State 0 has none; it follows a character that is in no phrase."""

    languages: list[str]
    roots: np.ndarray
    symbols: np.ndarray  # code point to symbol; those beyond its end are unseen
    moves: Moves


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of a sequence of symbols; state 0 is its root."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def build(samples: dict[str, list[str]]) -> Model:
    """A model of the samples of each language; samples are joined, with a break between two."""
    languages = sorted(samples)
    joined = {k: np.concatenate([np.append(codes(t), np.uint32(_BREAK)) for t in samples[k]]) for k in languages}
    seen = np.unique(np.concatenate([np.zeros(0, np.uint32), *joined.values()]))
    seen = seen[seen != _BREAK]
    symbols = np.full(int(seen[-1]) + 1 if len(seen) else 1, _UNSEEN, np.int32)
    symbols[seen] = np.arange(2, len(seen) + 2)
    empty = np.zeros(0, np.int32)
    states, moved, nexts, roots = [empty], [empty], [empty], []
    at = 1
    for k in languages:
        moves = suffix_automaton(joined[k])
        sizes = np.fromiter(map(len, moves), np.int32, len(moves))
        code = np.fromiter((c for out in moves for c in out), np.int64, sizes.sum())
        to = np.fromiter((x for out in moves for x in out.values()), np.int32, sizes.sum()) + np.int32(at)
        state = np.repeat(np.arange(len(moves), dtype=np.int32), sizes) + np.int32(at)
        real = code != _BREAK
        states.append(state[real])
        moved.append(symbols[code[real]])
        nexts.append(to[real])
        roots.append(at)
        at += len(moves)
    table = Moves(*map(np.concatenate, (states, moved, nexts)), at, len(seen) + 2)
    return Model(languages, np.array(roots, np.int64), symbols, table)


def learn(documents: DataFrame, label: str, text: str, docs: int = DOCS, per_doc: int = PER_DOC, chars: int = CHARS) -> Model:
    """A model of at most ``docs`` distinct texts of each label, those whose hashes are the least; null labels and texts teach nothing.

    Of a text of more than ``per_doc`` code points, a stretch of as many that begins at a place its hash names is learnt. Hashes alone are
    shuffled, once for each label and task's distinct texts, so a label or text that holds most rows costs no more than another.
    """
    usable = documents.where(F.col(label).isNotNull() & (F.length(text) > 0))
    usable = usable.select(F.col(label).cast("string").alias("label"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    # the least of each of 64 parts of a label first, so that no task sorts all hashes of one
    part = F.row_number().over(Window.partitionBy("label", "part").orderBy("hash"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("hash"))
    few = usable.select("label", "hash").distinct().withColumn("part", F.col("hash").bitwiseAND(F.lit(63))).withColumn("rank", part)
    chosen = few.where(F.col("rank") <= docs).select("label", "hash").withColumn("rank", rank).where(F.col("rank") <= docs)
    begin = F.pmod(F.col("hash"), F.greatest(F.char_length("text") - per_doc + 1, F.lit(1))).cast("int") + 1
    found = usable.join(F.broadcast(chosen), ["label", "hash"])  # at most ``docs`` hashes for each label
    found = found.groupBy("label", "rank").agg(F.min(F.substring("text", begin, F.lit(per_doc))).alias("text"))
    samples: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for row in found.orderBy("label", "rank").collect():
        if size.get(row.label, 0) < chars:
            samples.setdefault(row.label, []).append(row.text[: chars - size.get(row.label, 0)])
            size[row.label] = size.get(row.label, 0) + len(row.text)
    return build(samples)


def _parse(model: Model, state: np.ndarray, symbol: np.ndarray, root: np.ndarray, root_base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after one character each, and whether a phrase began with it."""
    moves = model.moves
    to, begun = moves(moves.base.take(state), state, symbol)
    where = np.flatnonzero(begun)
    # a character that is in no sample is a phrase of its own, which nothing continues
    again, unseen = moves(root_base.take(where), root.take(where), symbol.take(where))
    again[unseen] = 0
    to[where] = again
    return to, begun


def _counted(model: Model, columns: np.ndarray, first: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Phrases that begin in each segment, for automata with these roots: an array (roots, segments).

    ``columns`` has a segment in each of its columns, ``first`` says which begin a text. All are parsed at once as if a phrase began with each. Where
    the one before ends within a phrase, a segment is then parsed on from there until both parses begin a phrase at one place, from which on
    they are the same; and again as long as the end of the one before changes.
    """
    length, n = columns.shape
    root = np.repeat(roots, n)
    root_base = model.moves.base[root]
    begun = np.zeros((length, len(root)), bool)
    state = np.zeros(len(root), np.int64)
    for i, column in enumerate(columns):
        state, begun[i] = _parse(model, state, np.tile(column, len(roots)), root, root_base)
    begun &= np.tile(columns != _PAD, len(roots))
    alone = begun.sum(0)
    count, ends = alone.copy(), state.copy()
    inner = np.flatnonzero(np.tile(~first, len(roots)))
    entered = np.zeros(len(root), np.int64)
    while len(lanes := inner[entered[inner] != ends[inner - 1]]):
        now = ends[lanes - 1]
        entered[lanes] = now
        own, before, after, on = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64), state[lanes], np.arange(len(lanes))
        for i, column in enumerate(columns):
            at = lanes[on]
            symbol = column[at % n]
            now, begins = _parse(model, now, symbol, root[at], root_base[at])
            begins &= symbol != _PAD
            was = begun[i, at]
            met = begins & was
            own[on] += begins & ~met
            before[on] += was & ~met
            if met.any():
                own[on[met]] += alone[at[met]] - before[on[met]]
                on, now = on[~met], now[~met]
            if not len(on):
                break
        after[on] = now
        count[lanes], ends[lanes] = own, after
    return count.reshape(len(roots), n)


def phrases(model: Model, texts: list[np.ndarray], segment: int | None = None) -> np.ndarray:
    """Number of phrases of each text (arrays of code points) for each language; the length of segments changes nothing."""
    segment = segment or SEGMENT
    sizes = np.array([len(t) for t in texts], np.int64)
    pieces = -(-sizes // segment)
    flat = np.full(int(pieces.sum()) * segment, _PAD, np.int64)
    begins = np.cumsum(pieces) - pieces
    for t, a in zip(texts, begins * segment, strict=True):
        part = model.symbols[np.minimum(t, len(model.symbols) - 1)]
        part[t >= len(model.symbols)] = _UNSEEN
        flat[a : a + len(t)] = part
    columns = np.ascontiguousarray(flat.reshape(-1, segment).T)
    first = np.zeros(columns.shape[1], bool)
    first[begins[pieces > 0]] = True
    of = np.repeat(np.arange(len(texts)), pieces)
    out = np.zeros((len(texts), len(model.languages)))
    step = max(1, AT_ONCE // max(1, columns.size))
    for low in range(0, len(model.languages), step):
        for i, row in enumerate(_counted(model, columns, first, model.roots[low : low + step])):
            out[:, low + i] = np.bincount(of, row, len(texts))
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text: how far the runner-up's phrases exceed the winner's, from 0 (a tie) to 1.

    A text that is null or has no letter, or a model without languages, gives ``und`` and 0; ties go to the first language.
    """
    known = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
    languages, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    low = 0
    while low < len(known):
        part, size = [], 0
        while low < len(known) and (not part or size < 1_000_000):
            part.append(known[low])
            size += len(texts[known[low]])
            low += 1
        found = phrases(model, [codes(texts[i]) for i in part])
        order = np.sort(found, axis=1)
        for i, best, row in zip(part, found.argmin(1), order, strict=True):
            languages[i] = model.languages[best]
            scores[i] = float(1 - row[0] / row[1]) if len(row) > 1 else 1.0
    return languages, scores


def identify(documents: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row. Texts stay where they are; the model, bounded by ``learn``, is broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"
    place = keep.index(text) if text in keep else len(keep)

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                languages, scores = predict(shared.value, part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keep))), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                    [*keep, "lang_pred", "score"],
                )
        give_back()

    given = documents.select(*keep) if text in keep else documents.select(*keep, F.col(text).alias("__text"))
    return given.mapInArrow(on_partition, schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder modulo 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predicted(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model of those that aren't held out."""
    marked = documents.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = learn(marked.where(~F.col("held_out")), "lang", "text")
    return identify(marked, model, keep=("doc_id", "held_out"))
