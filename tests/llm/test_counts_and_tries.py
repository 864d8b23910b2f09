"""Importance resampling, token counts and prefix tries against brute force or the library."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece

from tessellary.llm import importance, prefix_trie, token_counts
from tessellary.llm.queries import PIECES

SMALL = "/root/testdata/sf0.001"


def resampled_by_hand(docs, target, percent=5):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    here, there = [0] * 10000, [0] * 10000
    found = [(i, *features(t)) for i, t in docs]
    for counts, lists in ((here, [x for _, _, x in found]), (there, [features(t)[1] for t in target])):
        for bucket in (b for x in lists for b in x):
            counts[bucket] += 1
    s, t = sum(here) + 10000, sum(there) + 10000
    gain = [math.floor(1000 * math.log((there[b] + 1) * s / ((here[b] + 1) * t))) for b in range(10000)]
    rows = []
    for i, n, buckets in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        rows.append([n, (i is None, i or 0), (i, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))])
    order = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[2][3], r[1]))
    drawn = percent * len(order) // 100
    return sorted([(*r[2], k + 1 if k < drawn else None) for k, r in enumerate(order)] + [(*r[2], None) for r in rows if r[0] < 20], key=str)


def resampled_rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_of_the_tables(spark):
    docs, target = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = resampled_by_hand([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert resampled_rows(importance.resampled(docs, target)) == want
    assert sum(r[4] is not None for r in want) > 5


def test_resampling_of_odd_rows_in_small_blocks(spark):
    rng = random.Random(5)
    texts = ["Aa bb CC dd " * 40, None, "", "one", "x y", "é" * 300 + " a b", "中" * 10 + "_" + "z" * 200 + " q", "-" * 500, "a " * 900]
    texts += [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(15, 40))) for _ in range(60)]
    rows = [(None if i == 12 else i // 2, t, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight string, rank string")
    target = spark.createDataFrame([("w1 w2 w3 w4",), (None,)], "text string")
    want = resampled_by_hand([r[:2] for r in rows], ["w1 w2 w3 w4", None], 30)
    got = importance.resampled(docs.repartition(3), target, percent=30, block=64)
    assert [r[:4] for r in resampled_rows(got)] == [r[:4] for r in want]
    assert sorted((r[3], r[4]) for r in resampled_rows(got) if r[4]) == sorted((r[3], r[4]) for r in want if r[4])


def test_resampling_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.resampled(none, target).collect() == []
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [r.rank for r in importance.resampled(one, none.drop("doc_id")).collect()] == [None]


def test_crc_of_joined_strings():
    crc = importance.Crc()
    for left, right in ((b"ab", b"x" * 70_000), (b"", b"q"), (b"z", "é中".encode()), (b"k", b"m" * (1 << 24)), (b"a", b"")):
        got = crc.join(np.array([zlib.crc32(left)], np.uint32), np.array([zlib.crc32(right)], np.uint32), np.array([len(right)]))
        assert got[0] == zlib.crc32(left + right)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_token_counts_of_random_texts(library):
    counter, rng = token_counts.Counter(PIECES), random.Random(1)
    parts = [" ", "  ", "\n", "▁", "a", "th", "ing", ".", ",", "<s>", "</s>", "<unk>", "<0x0A>", "é", "中", "😀", "\0", "x" * 70, "ا", "12", "﻿", "́", "�"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(10_000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FFF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 12))) for _ in range(5_000)]
    assert [counter.count(t) for t in texts] == [len(x) for x in library.encode(texts, num_threads=1)]


def test_token_counts_beyond_a_stretch_and_a_memory(library, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 100)
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    counter, rng = token_counts.Counter(PIECES), random.Random(2)
    texts = [" ".join("".join(rng.choices("etaoin", k=rng.randint(0, 9))) for _ in range(500)) for _ in range(5)] + ["中国the" * 20_000, " " * 1000, "ab\n" * 1000]
    assert [counter.count(t) for t in texts] == [len(x) for x in library.encode(texts, num_threads=1)]
    assert len(counter) < 600


def test_token_counts_of_rows(spark, library):
    texts = ["Hello world", None, "", "naïve 中国", "Hello world", "word " * 3000]
    rows = [(None if i == 3 else i // 2, t, "n") for i, t in enumerate(texts)]
    got = token_counts.counted(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PIECES, limit=1000).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(((*w, w[2] > 1000) for w in want), key=str)
    assert token_counts.counted(spark.createDataFrame([], "doc_id long, text string"), PIECES).collect() == []


def test_other_piece_models_are_refused(tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(bytes([0x12, 2, 0x18, 1]))  # a trainer message that names another kind of model
    with pytest.raises(ValueError, match="BPE"):
        token_counts.Counter(str(path))


def trie_by_hand(rows):
    own, members = defaultdict(list), defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    for turns in own.values():
        turns.sort()
    whole = {}
    for conv, turns in own.items():
        h, base = zlib.crc32(str(conv).encode()) % 4, int(math.copysign(abs(conv) // 20 * 20, conv))
        whole[conv] = [t[3:] for t in [*own.get(base, [])[:h], *turns[h:]]]
        for d in range(len(whole[conv]) + 1):
            members[tuple(whole[conv][:d])].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(convs) - 1) * words
    sha = lambda node: hashlib.sha256(",".join(map(str, sorted(c for c in members[node] if len(whole[c]) == len(node)))).encode()).hexdigest()
    return sorted(
        ((min(c), len(n), min(members[n[:-1]]) if n else None, len(c), children[n] if n in children else 0, leaves[n], saved[n], sha(n)) for n, c in members.items()),
        key=str,
    )


def trie_rows(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_trie_of_the_tables(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    want = trie_by_hand([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert trie_rows(prefix_trie.trie(df)) == want


def test_trie_of_odd_rows_in_many_tables(spark):
    rng = random.Random(3)
    ids, turns, roles, texts = [None, -41, -40, -3, 0, 1, 2, 3, 5, 20, 25, 39], [None, 0, 1, 2, 3], ["user", None, "assistant"], ["hi there", "", None, "a b c"]
    rows = [(rng.choice(ids), rng.choice(turns), rng.choice(roles), rng.choice(texts)) for _ in range(60)]
    rows += [(7000 + i, t, "user", "same words here") for i in range(30) for t in range(5)] + [(60, t, "u", f"t {t % 3}") for t in range(50)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int")
    assert trie_rows(prefix_trie.trie(df.repartition(5), size=7, fan=2)) == trie_by_hand(rows)


def test_trie_of_no_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 0, "user", "a")], schema)).collect() == []


def test_end_lists_are_hashed_across_rows(spark):
    lists = [(b"a", s, list(range(10 * s, 10 * s + 10))) for s in range(300)] + [(b"b", 0, [5])]
    got = {bytes(r.key): r.ends_sha256 for r in prefix_trie.ends_digests(spark.createDataFrame(lists, "key binary, slice long, ends array<long>")).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for k, ids in ((b"a", range(3000)), (b"b", [5]))}
