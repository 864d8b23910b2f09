"""Byte-level BPE by speculation: greedy longest match proposes, pairs are verified, only failing words are merged.

A sequence of tokens is the one that merging yields if and only if each token is what merging makes of its own bytes
and no two neighbours would have been merged across their border. The second is decided for arrays of pairs at
once, by walking both tokens' merges back in time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from .common import give_back

# Fixed value: the public pattern that splits text before byte-level merges, with the classes of letters and numbers left open.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"""
#: Code points that may be letters or numbers: the first four planes.
CLASSED = 0x40000
#: Words, and stretches between spaces, whose tokens a Python worker remembers; then it begins anew. Those of more characters than LONGEST
#: aren't remembered, which bounds what is held to some 500 bytes each.
REMEMBERED, LONGEST = 400_000, 64
#: Bytes of a word that is merged in an array with others; longer ones are merged one by one.
ABREAST = 48


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if printable, else one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(members: np.ndarray) -> str:
    """A set of code points as the inside of a character class."""
    edges = np.flatnonzero(np.diff(np.append(members, False).astype(np.int8), prepend=0)).reshape(-1, 2)
    return "".join(rf"\U{a:08x}-\U{b - 1:08x}" for a, b in edges.tolist())


@lru_cache(maxsize=1)
def word_patterns() -> tuple[regex.Pattern, regex.Pattern, re.Pattern]:
    """``PATTERN`` by the classes of the regex library, by those of the tokenizers library's version of Unicode, and the characters that differ.

    The tokenizers library's own splitter is asked for all code points: one that stays together with an "a" before it is a letter, with a "1" a
    number. The first pattern is faster and right for texts without a differing character, whatever version the executor's libraries have.
    """
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    points = [c for c in range(CLASSED) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))

    def theirs(before: str) -> np.ndarray:
        found = np.zeros(CLASSED, bool)
        for low in range(0, len(points), 4096):
            part = points[low : low + 4096]
            text = "".join(f"{before}{chr(c)}\n" for c in part)  # three characters each; the line's end is white space, so nothing joins the next
            found[[part[begin // 3] for _, (begin, end) in split(text) if begin % 3 == 0 and end == begin + 2]] = True
        return found

    def ours(name: str) -> np.ndarray:
        found = np.zeros(CLASSED, bool)
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            found[points[m.start() : m.end()]] = True
        return found

    letters, numbers = theirs("a"), theirs("1")
    differing = (letters != ours("L")) | (numbers != ours("N"))
    if differing[:256].any():
        raise ValueError("the libraries class characters of Latin-1 differently")
    usual, exact = (regex.compile(PATTERN.replace("{L}", x).replace("{N}", y)) for x, y in ((r"\p{L}", r"\p{N}"), (_ranges(letters), _ranges(numbers))))
    return usual, exact, re.compile(f"[{_ranges(differing)}]" if differing.any() else "(?!)")


class Tokenizer:
    """Encodes and decodes as the vocabulary file says: added tokens, byte-level pre-tokens, merges by rank."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        chars = byte_characters()
        raw = lambda token: bytes(chars[c] for c in token)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        special = "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))
        self.special = regex.compile(f"({special})") if special else None
        self.words, self.exact_words, self.differing = word_patterns()
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.added}
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for text, i in self.added.items():
            self.bytes[i] = text.encode()
        self.text = [str(i) for i in range(size)]
        self.numbers = list(range(size))  # so that one object stands for all uses of an id
        self.lengths = np.array([len(b) for b in self.bytes])
        # time at which a token is made: 0 for bytes, else 1 + the place of its merge; and the pair that makes it
        self.made = np.zeros(size, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"], 1):
            a, b = (self.ids[raw(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            new = self.ids[self.bytes[a] + self.bytes[b]]
            if (a, b) not in self.merges:
                self.merges[a, b] = (rank, new)
                if not self.made[new]:
                    self.made[new], self.left[new], self.right[new] = rank, a, b
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array([r for r, _ in self.merges.values()], np.int64)[order], 0)
        self.size = size
        self.result = np.zeros(len(model["merges"]) + 2, np.int64)
        for rank, new in self.merges.values():
            self.result[rank] = new
        self.byte_ids = np.array([self.ids.get(bytes([b]), 0) for b in range(256)], np.int64)
        self.known: dict[str, tuple[int, ...]] = {}
        self.stretches: dict[str, tuple[int, ...] | None] = {}
        # a token may be proposed only if merging its own bytes makes it
        self.whole = np.array([self.merged(t) == [i] if t and i not in self.added.values() else False for i, t in enumerate(self.bytes)])
        # bytes as characters of one byte, so that the automaton's leftmost longest matches are the greedy proposal
        self.matcher = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if self.whole[i]:
                self.matcher.add_word(t.decode("latin-1"), (i, len(t)))
        self.matcher.make_automaton()

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of least rank, the leftmost of equal ones."""
        tokens = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(tokens)
        after, before, alive = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
        heap = [(*m, i) for i in range(n - 1) if (m := self.merges.get((tokens[i], tokens[i + 1])))]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or self.merges.get((tokens[i], tokens[j])) != (rank, new):
                continue
            tokens[i], alive[j] = new, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merges.get((tokens[x], tokens[y]))):
                    heapq.heappush(heap, (m[0], x, m[1]))
        return [t for t, a in zip(tokens, alive, strict=True) if a]

    def merged_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words, one merge of each at a time."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        never = len(self.result) - 1
        low = 0
        while low < len(order):
            width = max(2, len(words[order[low]]) * 5 // 4 + 1)
            high = low
            while high < len(order) and len(words[order[high]]) <= width and high - low < 50_000:
                high += 1
            part, low = order[low:high], high
            if width > ABREAST:
                for i in part:
                    out[i] = self.merged(words[i])
                continue
            flat = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
            sizes = np.array([len(words[i]) for i in part])
            tokens = np.full((len(part), width + 1), -1, np.int64)
            tokens[:, :width][np.arange(width) < sizes[:, None]] = self.byte_ids[flat]
            ranks = self.rank(tokens[:, :-1], tokens[:, 1:], never)
            rows = np.array(part)
            places = np.arange(width + 1)
            while len(rows):
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
                done = best == never
                for i, row in zip(rows[done].tolist(), tokens[done].tolist(), strict=True):
                    out[i] = row[: row.index(-1)]
                keep = ~done
                rows, at, best, tokens, ranks = rows[keep], at[keep], best[keep], tokens[keep], ranks[keep]
                each = np.arange(len(rows))
                tokens[each, at] = self.result[best]
                tokens = np.take_along_axis(tokens, np.minimum(places + (places > at[:, None]), width), 1)
                tokens[:, -1] = -1
                ranks = np.take_along_axis(ranks, np.minimum(places[:-1] + (places[:-1] >= at[:, None]), width - 1), 1)
                ranks[:, -1] = never
                ranks[each, at] = self.rank(tokens[each, at], tokens[each, at + 1], never)
                left = at > 0
                each, at = each[left], at[left]
                ranks[each, at - 1] = self.rank(tokens[each, at - 1], tokens[each, at], never)
        return out

    def rank(self, a: np.ndarray, b: np.ndarray, never: int) -> np.ndarray:
        """Rank of the merge of each pair of tokens; ``never`` if there is none. -1 is no token."""
        key = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], never)

    def proposed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words, end to end, over the tokens that merging can make, and their number for each word."""
        joined = "\u0100".join(w.decode("latin-1") for w in words)
        found = [(end, *token) for end, token in self.matcher.iter_long(joined)]
        table = np.array(found, np.int64).reshape(-1, 3)
        ends = np.cumsum([len(w) + 1 for w in words])
        return table[:, 1], np.bincount(np.searchsorted(ends, table[:, 0], "right"), minlength=len(words))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a[i] and b[i], each one token, leaves just these two.

        Going back in time, the later made of the two tokens at the border is replaced by its part at the border; a merge of
        the two that are there is a fault if it comes while both are: after they were made and before either was used up.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        until_a = np.full(len(a), np.iinfo(np.int64).max)  # when the token at the border is used up by a merge in its own token
        until_b = until_a.copy()
        while len(open_):
            x, y = a[open_], b[open_]
            key = x * self.size + y
            at = np.searchsorted(self.keys, key)
            rank = np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max)
            # of merges of one rank the leftmost comes first: the left token's own merge goes before one at the border, the right's after
            fault = (rank < until_a[open_]) & (rank <= until_b[open_]) & (rank < np.iinfo(np.int64).max)
            good[open_[fault]] = False
            made_x, made_y = self.made[x], self.made[y]
            going = ~fault & ((made_x > 0) | (made_y > 0))
            open_, x, y, made_x, made_y = open_[going], x[going], y[going], made_x[going], made_y[going]
            back_x = made_x > made_y
            i, j = open_[back_x], open_[~back_x]
            until_a[i], a[i] = made_x[back_x], self.right[x[back_x]]
            until_b[j], b[j] = made_y[~back_x], self.left[y[~back_x]]
        return good

    def learn(self, words: list[str]) -> None:
        """Remember the tokens of words (not empty) that aren't known yet."""
        raw = [w.encode() for w in words]
        flat, sizes = self.proposed(raw)
        of = np.repeat(np.arange(len(words)), sizes)
        border = np.flatnonzero(of[1:] == of[:-1])
        pairs, place = np.unique(flat[border] * self.size + flat[border + 1], return_inverse=True)
        fault = ~self.compatible(pairs // self.size, pairs % self.size)
        failing = np.zeros(len(words), bool)
        failing[of[border[fault[place]]]] = True
        # a proposal must cover its word: bytes without a token of their own are left to exact merging, which says so
        covered = np.bincount(of, self.lengths[flat], len(words))
        failing |= covered != [len(w) for w in raw]
        again = np.flatnonzero(failing).tolist()
        exact = dict(zip(again, self.merged_all([raw[i] for i in again]), strict=True))
        tokens, at = flat.tolist(), 0
        number = self.numbers
        for i, (word, n) in enumerate(zip(words, sizes.tolist(), strict=True)):
            self.known[word] = tuple(map(number.__getitem__, exact[i] if i in exact else tokens[at : at + n]))
            at += n

    def _differs(self, text: str) -> bool:
        """Whether a text has a character that the two libraries class differently; none of Latin-1 is, which is seen faster."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.differing.search(text) is not None
        return False

    def _words(self, texts: list[str]) -> list[tuple[int, ...]]:
        """Tokens of texts without added tokens, by the pattern and what is known of its words."""
        split = [(self.words if t.isascii() or not self._differs(t) else self.exact_words).findall(t) for t in texts]
        new = {w for words in split for w in words if w not in self.known}
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
            new = {w for words in split for w in words}
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        out = [tuple(chain.from_iterable(map(get, words))) for words in split]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return out

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of texts without added tokens.

        If none of the stretches between a text's spaces begins with white space, the pattern splits each, with the space before
        it, alike in every text, so known stretches need no matching. Other texts are matched as a whole.
        """
        split = [t.split(" ") for t in texts]
        stretches = self.stretches
        new = {s for parts in split for s in parts[1:] if s not in stretches}
        if len(stretches) + len(new) > self.remembered:
            stretches.clear()
            new = {s for parts in split for s in parts[1:]}
        odd = {s for s in new if not s or s[0].isspace()}
        stretches.update(dict.fromkeys(odd))
        learnt = list(new - odd)
        stretches.update(zip(learnt, self._words([" " + s for s in learnt]), strict=True))
        get = stretches.__getitem__
        found = [list(map(get, parts[1:])) for parts in split]
        for x in new:
            if len(x) > LONGEST:
                del stretches[x]
        whole = [None in x for x in found]
        rest = iter(self._words([t if w else p[0] for t, w, p in zip(texts, whole, split, strict=True)]))
        return [list(next(rest)) if w else [*next(rest), *chain.from_iterable(x)] for w, x in zip(whole, found, strict=True)]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text. Texts may be empty; memory beyond theirs is bounded by ``remembered`` words of at most LONGEST characters."""
        if not any(x in t for x in self.added for t in texts):
            return self._encode(texts)
        parts = [self.special.split(t) for t in texts]
        flat = iter(self._encode([p for x in parts for p in x if p not in self.added]))
        return [list(chain.from_iterable([self.added[p]] if p in self.added else next(flat) for p in x)) for x in parts]

    def decode(self, ids: list[int]) -> str:
        """The text of token ids, added tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode_batch(self, batch: list[list[int]]) -> list[str]:
        return [self.decode(ids) for ids in batch]


@lru_cache(maxsize=2)
def tokenizer(path: str, remembered: int = REMEMBERED) -> Tokenizer:
    """The tokenizer of a file, once for each Python worker."""
    return Tokenizer(path, remembered)


def encoded(
    documents: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, forget: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of every row, and the ids themselves ``with_ids``. Null text is empty.

    The vocabulary's path must be there on every executor, as it is part of an installed package. Rows are independent; nothing is shuffled.
    ``remembered`` bounds the words that a worker remembers; it changes no result. With ``forget`` a worker returns what stages before left, and drops the tokenizer with all it remembers at the end of a partition, which leaves that memory to the stages that follow.
    """
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices of about a million bytes of text, a single row at least."""
        for batch in batches:
            low = size = 0
            for i, n in enumerate(pc.binary_length(batch.column(len(keep))).to_pylist()):
                size += n or 0
                if size > 1_000_000:
                    yield batch.slice(low, i + 1 - low)
                    low, size = i + 1, 0
            if low < batch.num_rows:
                yield batch.slice(low)

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if forget:
            give_back()
        tokens = tokenizer(vocabulary, remembered)
        if forget:
            give_back()  # the vocabulary's file as read
        for part in pieces(batches):
            ids = tokens.encode_batch([x or "" for x in part.column(len(keep)).to_pylist()])
            decoded = tokens.decode_batch(ids)
            texts = [",".join(map(tokens.text.__getitem__, x)) for x in ids]
            out = [pa.array(map(len, ids), pa.int64()), pa.array(map(sha, texts)), pa.array(map(sha, decoded))]
            if with_ids:
                flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *out], names)
        if forget:
            del tokens
            tokenizer.cache_clear()
            give_back()

    return documents.select(*keep, documents[text].alias("__text")).mapInArrow(on_partition, schema)
