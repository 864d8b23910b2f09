"""Token counts by byte-pair merging on a heap and a linked list: no token is looked up, only merges are counted.

The vocabulary is a piece model (BPE by scores, with byte fallback). A text begins as its characters, each one symbol if the
vocabulary has it, else as many as it has UTF-8 bytes; every merge takes one symbol away, so tokens = symbols - merges.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The mark that stands for a space in pieces; types of pieces and the kind of model in the public file format.
SPACE, NORMAL, UNUSED, USER_DEFINED, BYTE, BPE = "▁", 1, 5, 4, 6, 2
#: Words, and parts of words, whose counts a Python worker remembers; then it begins anew. Those of over LONGEST characters aren't remembered.
REMEMBERED, LONGEST = 600_000, 64
#: Characters of a text whose words are listed at a time, and of the texts that are handled together.
STRETCH = 1_000_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields in the public wire format; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, raw[at : at + size]
        at += size


class Counter(dict):
    """Counts tokens as the model file says; maps each word that it remembers (with the spaces before it) to its number of tokens.

    No merge joins two characters that no piece has side by side, so a text falls apart at such borders; where pieces hold
    spaces only in front, borders before spaces are such, and words can be counted one by one.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.parts: dict[str, int] = {}
        message: dict[int, list] = {1: [], 2: [b""], 3: [b""]}
        for number, value in _fields(Path(path).read_bytes()):
            message.setdefault(number, []).append(value)
        pieces = [dict(_fields(p)) for p in message[1]]
        training, normal = dict(_fields(message[2][-1])), dict(_fields(message[3][-1]))
        kinds = {p.get(3, NORMAL) for p in pieces}
        if training.get(3) != BPE or not training.get(35) or training.get(24) or kinds & {UNUSED, USER_DEFINED}:
            raise ValueError("only BPE models with byte fallback, without unused or user-defined pieces, are known")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only models that keep text as it is, but for marking spaces, are known")
        self.prefix = " " if normal.get(3, 1) else ""
        # a space is itself here, as the text has it
        self.order = {p[1].decode().replace(SPACE, " "): -struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces if p.get(3, NORMAL) == NORMAL}
        long = [p for p in self.order if len(p) > 1]
        if any(c not in self.order for p in long for c in p):
            raise ValueError("a piece has a character that is no piece itself")
        if any(" " in p.lstrip(" ") for p in long):
            raise ValueError("a piece has a space that isn't in front")
        self.neighbours = {p[i : i + 2] for p in long for i in range(len(p) - 1)}
        self.words, self.border = re.compile(" +[^ ]*|[^ ]+"), re.compile("(?<! ) ")

    def __missing__(self, word: str) -> int:
        """Tokens of a word: the sum over its parts between borders that no merge can cross."""
        total, low, neighbours = 0, 0, self.neighbours
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in neighbours:
                total += self._part(word[low:i])
                low = i
        total += self._part(word[low:])
        if len(word) <= LONGEST:
            self[word] = total
        return total

    def _part(self, part: str) -> int:
        if len(part) == 1:
            return 1 if part in self.order else len(part.encode())
        if len(part) > LONGEST:
            return len(part) - self.merges(part)
        if (known := self.parts.get(part)) is None:
            known = self.parts[part] = len(part) - self.merges(part)
        return known

    def merges(self, part: str) -> int:
        """Merges until no pair of neighbours is a piece, of all pairs always that of best score, the leftmost of equal ones.

        ``part`` has only characters that are pieces. Symbols are linked by where they begin and end.
        """
        order, n = self.order, len(part)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1") * n
        alive.append(0)
        heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := order.get(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, low, middle, high = heapq.heappop(heap)
            if not (alive[low] and alive[middle] and end[low] == middle and end[middle] == high):
                continue
            done += 1
            end[low], alive[middle] = high, 0
            before[high] = low
            if low and (rank := order.get(part[(x := before[low]) : high])) is not None:
                heapq.heappush(heap, (rank, x, low, high))
            if high < n and (rank := order.get(part[low : (x := end[high])])) is not None:
                heapq.heappush(heap, (rank, low, high, x))
        return done

    def count(self, text: str) -> int:
        """Tokens of a text; the empty text has none. Memory beyond the text's own is bounded by STRETCH and REMEMBERED."""
        if not text:
            return 0
        text = self.prefix + text.replace(SPACE, " ")
        total = low = 0
        while low < len(text):
            cut = self.border.search(text, low + STRETCH) if low + STRETCH < len(text) else None
            high = cut.start() if cut else len(text)
            total += sum(map(self.__getitem__, self.words.findall(text, low, high)))
            low = high
            for memory in (self, self.parts):
                if len(memory) > REMEMBERED:
                    memory.clear()
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of a model file, once for each Python worker."""
    return Counter(path)


def counted(documents: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """``keep``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row, whatever else it has. Null text is empty.

    Empty texts have no tokens; control pieces inside a text are ordinary characters. Rows are independent and keep their number, repeated ones
    too; nothing is shuffled. The vocabulary's path must be there on every executor, as it is part of an installed package.
    """
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep) + ", n_bytes bigint, n_tokens bigint, over_limit boolean"
    names = [*keep, "n_bytes", "n_tokens", "over_limit"]

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            texts = batch.column(len(keep))
            tokens = pa.array((count(t.as_py() or "") for t in texts), pa.int64())
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes, tokens, pc.greater(tokens, limit)], names)

    return documents.select(*(documents[c] for c in keep), F.col(text).alias("__text")).mapInArrow(on_partition, schema)
