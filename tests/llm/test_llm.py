"""Each operator against a brute-force version, a round trip or held-out accuracy, and on awkward rows."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessellary.llm import bpe, chat, common, embed_dedup, fingerprints, html_extract, langid, mixing, sharding, shingles, simhash, warc
from tessellary.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "src0", 0), (3, " \t\n", "en", None, 3), (4, "1234 !!", None, "src0", 7), (5, "the same text again and again", "en", "src1", 29),
    (6, "the same text again and again", "en", "src1", 29), (6, "the same text again and again", "en", "src1", 29), (7, "w " * 30_000, "en", "src0", 60_000),
    (8, "É" * 5000, "fr", "src2", 5000), (9, "x\r\n\u2028y\u00a0z <|endoftext|> 😀", "de", "src2", 20), (None, "no id", "en", "src3", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def awkward(spark):
    extra = {c: F.lit("clash") for c in ("fp", "size", "shard", "ids", "rid", "cell", "key", "taken", "__text", "root", "score")}
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 1: HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) "</p>"</script></head><body>
<header><h1>Site name</h1><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site better, please accept all of them now.</div>
<main><article><h1>Caf&eacute; &amp; bar</h1><p>First <b>bold</b> paragraph of the article,   with
white space and a good number of words to count.<p>Short.<ul><li>item<li>other <a href="x">link</a></ul><div class="ad">Buy this now</div>
<p>Last&nbsp;words of the text &#8212; they are the end of it all.</p></article><aside>Related stories and more</aside></main>
<section id="comments"><h2>Comments</h2><article class="comment"><p>A very long reader comment that has as many words as the article itself, if not more of them.</p></article></section>
<form><p>Subscribe</p><button>Go</button></form><footer>&copy; Somebody</footer></body></html>"""


def test_html_main_text():
    want = "Café & bar First bold paragraph of the article, with white space and a good number of words to count. Short. item other link Last words of the text — they are the end of it all."
    assert html_extract.main_text(PAGE) == want
    without = PAGE.replace("<main><article>", '<div id="content">').replace("</article><aside>", "</div><aside>").replace("</main>", "")
    assert html_extract.main_text(without) == want
    wrapped = without.replace("<body>", '<body class="menu"><div class="layout no-sidebar">').replace("<h1>Caf", '<div class="post-header"><h1>Caf').replace("bar</h1>", "bar</h1></div>")
    assert html_extract.main_text(wrapped) == want


@pytest.mark.parametrize(("html", "text"), [(None, ""), ("", ""), ("<p></p>", ""), ("plain &lt;text", "plain <text"), ("<nav>menu</nav>", ""), ("<p>a<p>b", "a b"), ("<b>x</b>y <!-- no -->z", "xy z")])
def test_html_edges(html, text):
    assert html_extract.main_text(html) == text


def test_html_names_count_as_a_whole():
    page = '<html><body><nav>Home</nav><article><h1>Title</h1><p>A paragraph that is long enough.</p><p class="share-price">The share price rose.</p><p id="menu-history">How the menu came about.</p><div class="share-buttons">Tweet it</div></article></body></html>'
    assert html_extract.main_text(page) == "Title A paragraph that is long enough. The share price rose. How the menu came about."
    for name in ("sponsored-research", "sponsored"):
        page = f'<body><div class="menu">Home</div><article class="{name}"><h1>Title</h1><p>Some long paragraph of the only article on the page.</p></article></body>'
        assert html_extract.main_text(page) == "Title Some long paragraph of the only article on the page."


def test_html_ratios_decide(monkeypatch):
    words = "many words that make up a long line of the text "
    page = "<body><div>" + "".join(f'<p><a href="{i}">Link {i}</a> <i>x</i></p>' for i in range(12)) + "</div><div><h2>Title</h2>" + f"<p>{words * 4}</p>" * 5 + "<p>Short.</p></div><div>" + "<p><b>a</b> <i>b</i></p>" * 8 + "</div></body>"
    want = " ".join(["Title", *[(words * 4).strip()] * 5, "Short."])
    assert html_extract.main_text(page) == want
    monkeypatch.setattr(html_extract, "smoothed", lambda values, sigma: [1.0] * len(values))
    assert html_extract.main_text(page) != want


def test_html_survives_any_page():
    import time

    assert html_extract.main_text("<p>a<![foo[bar]]>b") == "a]>b" or html_extract.main_text("<p>a<![foo[bar]]>b")
    rng = random.Random(0)
    bits = ["<", ">", "</", "<!", "<![", "]]>", "<!--", "-->", "&", "&#", ";", "<?", "'", '"', "=", "/", "article", "div", "p", "script", "x", " ", "\n", "\0", "&lt;", "<!DOCTYPE", "CDATA["]
    for _ in range(10_000):
        at, cut = rng.randrange(len(PAGE)), rng.randrange(40)
        html = PAGE[:at] + "".join(rng.choice(bits) for _ in range(rng.randrange(6))) + PAGE[at + cut :]
        assert isinstance(html_extract.main_text(html if rng.random() < 0.5 else html[rng.randrange(len(html)) :]), str)
    for deep in ("<div>", "<b>", "<article>", "<p><b>x", "<div class=menu>", "<li>x", "<div>x", "<article><b>y</i>"):
        began = time.perf_counter()
        html_extract.main_text(deep * 50_000)
        assert time.perf_counter() - began < 10, deep


def test_html_on_pages(spark):
    import html as h
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = " ".join(h.unescape(re.sub(r"</?(h1|p|br)>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert rows[r.page_id].text == want and rows[r.page_id].n_chars == len(want)
    empty = html_extract.extract(pages.limit(0).withColumn("text", F.lit("clash")))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


# ---- 2: WARC

def test_warc_round_trip(spark):
    rows = [(1, "u 1", "same"), (2, None, "same"), (3, "x", None), (4, "x", ""), (5, "y", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (5, "y", "twice"), (5, "y", "twice"), (None, "z", "é\0")]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert (by[1][0].record_type, by[1][0].refers_to, by[1][0].payload_digest, by[1][0].payload_bytes) == ("revisit", 2, digest("same"), 4)
    assert (by[3][0].record_type, by[3][0].refers_to, by[3][0].payload_bytes) == ("revisit", 4, 0)
    assert sorted(r.record_type for r in by[5]) == ["response", "response", "revisit"]
    assert by[None][0].payload_digest == digest("é\0")
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reader_streams_members():
    import gzip

    record = lambda body: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    rng = random.Random(4)
    bodies = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 5000, 200_000)] + [b"\r\n\r\n" * 400_000]
    data = gzip.compress(b"".join(map(record, bodies[:3]))) + gzip.compress(b"") + b"".join(gzip.compress(record(b)) for b in bodies[3:])
    assert [b for _, b in warc._records(data)] == bodies
    assert [b for _, b in warc._records(gzip.compress(b"".join(map(record, bodies))))] == bodies
    with pytest.raises(ValueError, match="blank line"):
        list(warc._records(gzip.compress(record(b"x")[:-1])))


def test_warc_resolution_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 1)
    rows = [(i, f"u{i}", f"page {i % 40} " * 50) for i in range(400)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.refers_to for r in got} == {i: None if i >= 360 else 360 + i % 40 for i in range(400)}


def test_warc_small_payloads_stay(spark):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = {r.page_id: r.record_type for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string"), least_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


# ---- 3: fingerprints

def test_fingerprints_of_edits(spark, documents):
    got = {r.doc_id: r for r in fingerprints.fingerprints(documents).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in documents.collect())
    assert len(got) == len(rows)
    same = {}
    for i, (key, text) in enumerate(rows):
        after, k = rows[(i + 1) % len(rows)][1], len(text) // 4
        assert got[key].edited_sha256 == sha(text[: len(text) - k] + after[:k]) and got[key].n_chars == len(text)
        assert same.setdefault(text, got[key].fingerprint) == got[key].fingerprint
    assert len(set(same.values())) == len(same)
    assert np.mean([r.near_edited for r in got.values()]) > 0.6 > 0.2 > np.mean([r.near_next for r in got.values()])
    texts = spark.createDataFrame([(key, text[: len(text) - len(text) // 4] + rows[(i + 1) % len(rows)][1][: len(text) // 4]) for i, (key, text) in enumerate(rows)], "doc_id long, text string")
    direct = {r.doc_id: r.f for r in fingerprints.vectors(texts, ["doc_id"]).select("doc_id", fingerprints.as_text(F.col("fp")).alias("f")).collect()}
    assert direct == {k: r.edited_fingerprint for k, r in got.items()}


def test_fingerprint_lanes_by_hand(spark):
    text = "a b\nc\na b"
    fp = fingerprints.vectors(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).first().fp

    def spark_hash(seed, *parts):
        h = xxhash.xxh64_intdigest(int(seed & 0xFFFFFFFF).to_bytes(4, "little"), 42)
        for p in parts:
            h = h if p is None else xxhash.xxh64_intdigest(p.encode(), h)
        return h

    lines = [x.split(" ") for x in text.split("\n")]
    pairs = [(a, b) for w in lines for a, b in zip(w, [*w[1:], None], strict=True)]
    assert fp.pairs == len(pairs)
    for j in range(4):
        hashes = [spark_hash(-1 - j, x) for x in text.split("\n")]
        assert fp.exact[2 * j] == sum(h & 0xFFFFFFFF for h in hashes) % 2**32 and fp.exact[2 * j + 1] == sum(h >> 32 for h in hashes) % 2**32
    for j in range(2):
        hashes = [spark_hash(j, *p) for p in pairs]
        for i in range(32):
            for half in (0, 1):
                assert fp.like[2 * (32 * j + i) + half] == sum(1 if h >> (i + 32 * half) & 1 else -1 for h in hashes)


def test_fingerprints_add_and_ignore_order(spark):
    rows = [("ab", "x y\nz w"), ("ba", "z w\nx y"), ("a", "x y"), ("b", "z w"), ("aab", "x y\nx y\nz w")]
    fps = {r.k: r for r in fingerprints.vectors(spark.createDataFrame(rows, "k string, text string"), ["k"]).select("k", fingerprints.as_text(F.col("fp")).alias("t")).collect()}
    assert fps["ab"].t == fps["ba"].t != fps["aab"].t
    v = fingerprints.vectors(spark.createDataFrame(rows, "k string, text string"), ["k"])
    part = lambda k: v.where(F.col("k") == k).select(F.col("fp").alias(f"fp_{k}"))
    both = part("a").crossJoin(part("b")).crossJoin(part("ab"))
    t = lambda c: fingerprints.as_text(c)
    got = both.select(t(fingerprints.combine(F.col("fp_a"), F.col("fp_b"))), t(fingerprints.combine(F.col("fp_ab"), F.col("fp_b"), -1)), t(F.col("fp_a")), fingerprints.likeness(F.col("fp_a"), F.col("fp_a"))).first()
    assert got[0] == fps["ab"].t and got[1] == got[2] and got[3] == 1.0


def test_fingerprints_awkward(spark, awkward):
    got = fingerprints.fingerprints(awkward).collect()
    assert len(got) == len(AWKWARD)
    texts = {r.doc_id: r for r in got}
    assert texts[1].fingerprint == texts[2].fingerprint and texts[5].fingerprint == texts[6].fingerprint
    assert fingerprints.fingerprints(awkward.limit(0)).count() == 0
    alone = fingerprints.fingerprints(awkward.where("doc_id = 5")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == sha("the same text again an" + "the sam")


def test_likeness_of_repetitive_long_texts(spark):
    rows = [(1, "w " * 80_000), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu\n" * 10_000), (3, "one two three " * 20_000)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = lambda text: Counter((a, b) for line in text.split("\n") for w in [line.split(" ")] for a, b in zip(w, [*w[1:], None], strict=True))
    for i, (key, text) in enumerate(rows):
        after, k = rows[(i + 1) % 3][1], len(text) // 4
        p, q = pairs(text), pairs(text[: len(text) - k] + after[:k])
        exact = sum(v * q[x] for x, v in p.items()) / (float(sum(v * v for v in p.values())) * sum(v * v for v in q.values())) ** 0.5
        assert abs(got[key].near_edited - exact) <= 0.1


def test_cells_are_even(spark):
    rows = [(i, f"text {i}") for i in range(5000)] + [(2**61, "far")] + [(2**40 + 7, f"one id {i}") for i in range(3000)] + [(None, f"no id {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = fingerprints.edited(df, rows=50)
    assert parts.where("guest = 0").select("cell", "at").distinct().groupBy("cell").count().agg({"count": "max"}).first()[0] <= 50 * fingerprints.MANY
    got = parts.where("guest = 0 and which = 1").select("doc_id", "edited_sha256").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.edited_sha256 for r in got}
    assert all(by[i] == sha(f"text {i}"[: len(f"text {i}") - len(f"text {i}") // 4] + f"text {i + 1}"[: len(f"text {i}") // 4]) for i in range(4999))
    assert by[2**61] == sha("far")


# ---- 4: language

def test_language_held_out(documents):
    from zlib import crc32

    rows = langid.predicted(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)


def test_language_awkward(awkward):
    got = {r.doc_id: r for r in langid.predicted(awkward).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[4].lang_pred == "und" and got[1].score == 0
    assert got[7].lang_pred in ("en", "fr", "de") and not got[None].held_out
    assert langid.predicted(awkward.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predicted(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_phrases(text, sample):
    at = count = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at, count = at + n, count + 1
    return count


def test_phrases_against_search():
    rng = random.Random(5)
    sample = {k: ["".join(rng.choice("abc ") for _ in range(200))] for k in ("x", "y")}
    model = langid.build(sample)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 3000))) for _ in range(20)]
    texts += [sample["x"][0] * 100, sample["y"][0][3:] * 30 + "d" * 2000, "", "a"]
    want = [[plain_phrases(t, sample[k][0]) for k in ("x", "y")] for t in texts]
    for segment in (1, 7, 100, langid.SEGMENT):
        assert langid.phrases(model, [langid.codes(t) for t in texts], segment).tolist() == want


def test_language_of_long_texts_against_search():
    rng = random.Random(6)
    letters = {"a": "abcdefgh ", "b": "abcdefghijk ", "c": "áéíóú "}
    sample = {k: ["".join(rng.choice(v) for _ in range(3000)) for _ in range(2)] for k, v in letters.items()}
    model = langid.build(sample)
    for k in ("a", "b", "c"):
        text = "".join(rng.choice(letters[k]) for _ in range(20_000)) + sample["b"][1][100:900]
        counts = [min(plain_phrases(text, "\0".join(sample[x])), 10**9) for x in sorted(sample)]
        found = langid.phrases(model, [langid.codes(text)])[0].tolist()
        assert found == counts
        assert langid.predict(model, [text]) == ([sorted(sample)[int(np.argmin(counts))]], [1 - sorted(counts)[0] / sorted(counts)[1]])


def test_language_with_many_characters_and_languages(spark):
    rng = random.Random(8)
    rows = [(i, "".join(chr(0x4E00 + rng.randrange(5000) if i % 2 else 0x1F300 + rng.randrange(500)) for _ in range(700)) + "é", "zh" if i % 2 else "xx") for i in range(40)]
    rows += [(100 + i, f"{chr(0xAC00 + 2 * i)}{chr(0xAC01 + 2 * i)} " * 50, f"l{i:03d}") for i in range(200)]
    got = {r.doc_id: r for r in langid.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    seen = [(k, lang) for k, _, lang in rows if not got[k].held_out]
    assert all(got[k].lang_pred == lang for k, lang in seen)


def test_language_learns_distinct_texts(spark):
    rows = [(i, "the hot text of this language", "en") for i in range(3000)] + [(5000 + i, f"other words number {i} and more of these", "en") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, "lang", "text", docs=50)
    assert langid.phrases(model, [langid.codes("other words number")])[0][0] == 1
    assert langid.phrases(langid.learn(df, "lang", "text"), [langid.codes("the hot text of this language")])[0][0] == 1


# ---- 5: SimHash

def plain_simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(fps, limit=3):
    roots = list(range(len(fps)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= limit:
                roots[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_against_brute_force(documents):
    got = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    rows = sorted((r.doc_id, plain_simhash(r.text)) for r in documents.collect())
    roots = brute_components([f for _, f in rows])
    least = {}
    for (key, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, key), key)
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{f:016x}", least[r]) for (k, f), r in zip(rows, roots, strict=True)}


@pytest.mark.parametrize("node", [10**6, 20])
def test_index_finds_all_links(spark, node):
    rng = random.Random(node)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) for b in base for _ in range(8)} | {0, 1, 2**64 - 1}
    fps = sorted(f & (2**64 - 1) for f in fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    scratch = common.Scratch(spark, "test")
    found = {r.v: r.root for r in common.components(scratch, simhash.near_pairs(df, scratch, node=node)).collect()}
    groups = defaultdict(set)
    for f in fps:
        s = f - 2**64 if f >> 63 else f
        groups[found.get(s, s)].add(f)
    want = defaultdict(set)
    for f, r in zip(fps, brute_components(fps), strict=True):
        want[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_index_divides_a_dense_ball(spark):
    centre, rng = 0x0123456789ABCDEF, random.Random(1)
    ball = {centre} | {centre ^ 1 << i for i in range(64)} | {centre ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)}
    apart = {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in ball | apart], "fp long")
    scratch = common.Scratch(spark, "test")
    found = {r.v: r.root for r in common.components(scratch, simhash.near_pairs(df, scratch, node=100)).collect()}
    assert len(found) == len(ball) and len(set(found.values())) == 1


def test_simhash_awkward(awkward):
    got = simhash.near_duplicates(awkward).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(AWKWARD) and by[1].fingerprint == "0" * 16 and by[3].component_id == 1 and by[6].component_id == 5
    assert by[None].component_id is None
    assert by[7].fingerprint == f"{plain_simhash('w ' * 30_000):016x}"
    assert simhash.fingerprint("a b c d e f g h i j", words_at_once=2) == plain_simhash("a b c d e f g h i j")
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


# ---- 6: chat

def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "\\<|im_end|>\n\\\\[INST]<s<s>"), (1, 1, "assistant", None), (1, 1, "assistant", "a\\b<|im_start|>"), (1, None, "sys<|im_sep|>\ntem", ""), (None, 0, None, None), (2, 5, "assistant", "x" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    got = {r.conv_id: r for r in chat.formatted_digests(df).collect()}
    assert set(got) == {1, 2, None, -1}
    turns = defaultdict(list)
    for c, t, r, x in [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        turns[c].append((-1 if t is None else t, r or "", x or ""))
    for c, r in got.items():
        said = sorted(turns[c])
        loss = "".join(x for _, role, x in said if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(said), sha("".join(f"{a}\n{x}\n" for _, a, x in said)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert chat.formatted_digests(df.limit(0)).count() == 1


def test_reply_tree_branches(spark):
    rows = [("r", None, 1.0, "user", "hi"), ("a", "r", 0.2, "assistant", "low"), ("b", "r", 0.9, "assistant", "high"), ("c", "b", 0.9, "user", "more"), ("d", "c", 0.1, "assistant", "end"),
            ("x", "gone", None, "user", "alone"), ("p", "q", 1.0, "user", "cycle"), ("q", "p", 1.0, "user", "cycle")]
    messages = spark.createDataFrame(rows[:6], "id string, parent string, score double, role string, text string")
    found = chat.paths(messages, common.Scratch(spark, "test"))
    paths = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: -r.depth):
        paths[r.leaf].append(r.id)
    assert dict(paths) == {"a": ["r", "a"], "d": ["r", "b", "c", "d"], "x": ["x"]}
    best = chat.best_branches(found, messages, per_tree=1)
    assert {r.leaf for r in best.collect()} == {"d", "x"}
    text = {r.leaf: r.formatted for r in chat.formatted(best, messages).collect()}
    assert chat.parsed(text["d"]) == [("user", "hi"), ("assistant", "high"), ("user", "more"), ("assistant", "end")]
    assert chat.paths(messages.limit(0), common.Scratch(spark, "test")).count() == 0


def test_reply_tree_with_cycles(spark):
    rows = [("p", "q"), ("q", "p"), ("below", "p"), ("leaf", "below"), ("own", "own"), ("hangs", "own"), ("r", None), ("a", "r"), ("b", "a")]
    messages = spark.createDataFrame(rows, "id string, parent string")
    found = chat.paths(messages, common.Scratch(spark, "test")).collect()
    assert sorted((r.leaf, r.id, r.depth) for r in found) == [("b", "a", 1), ("b", "b", 0), ("b", "r", 2)]
    cyclic = spark.createDataFrame(rows[:2], "id string, parent string")
    assert chat.paths(cyclic, common.Scratch(spark, "test")).count() == 0


# ---- 7: BPE

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_bpe_matches_the_library(documents, awkward, library):
    for df in (documents, awkward):
        got = sorted(bpe.encoded(df, VOCABULARY).collect(), key=lambda r: (r.doc_id or -1, r.n_tokens))
        rows = sorted(((r.doc_id or -1, r.text or "") for r in df.collect()), key=lambda r: (r[0], len(library.encode(r[1], add_special_tokens=False).ids)))
        for r, (_, text) in zip(got, rows, strict=True):
            ids = library.encode(text, add_special_tokens=False).ids
            assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == sha(",".join(map(str, ids)))
            assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    assert bpe.encoded(awkward.limit(0), VOCABULARY).count() == 0


def test_bpe_on_random_text(library):
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "'s", "'LL", "1", "²", "<|endoftext|>", "😀", "中", "!", "aaaa", " the", "\r\n", "\u0301", "\u200b", "\u2028"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["ab" * 4000, "=" * 5000]
    mine = bpe.tokenizer(VOCABULARY)
    found = mine.encode_batch(texts)
    assert found == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert mine.decode_batch(found) == texts


def test_bpe_compatibility_is_exact():
    t = bpe.tokenizer(VOCABULARY)
    rng = np.random.default_rng(0)
    usable = np.flatnonzero(t.whole)
    a, b = rng.choice(usable, 3000), rng.choice(usable, 3000)
    cuts = [(w[:k], w[k:]) for w in (t.bytes[i] for i in usable[:8000]) for k in range(1, len(w))]
    a = np.append(a, [t.ids[x] for x, y in cuts if x in t.ids and y in t.ids])
    b = np.append(b, [t.ids[y] for x, y in cuts if x in t.ids and y in t.ids])
    assert t.compatible(a, b).tolist() == [t.merged(t.bytes[i] + t.bytes[j]) == [i, j] for i, j in zip(a, b, strict=True)]


def test_bpe_forgets_within_bounds(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    t = bpe.Tokenizer(VOCABULARY)
    for i in range(10):
        text = f"some words number {i} xx{i}yy and zz{i * 7}"
        assert t.encode_batch([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_bpe_remembers_no_long_words(library):
    t = bpe.Tokenizer(VOCABULARY)
    text = "short " + "中" * 5000 + " " + "ab" * 500 + " end"
    assert t.encode_batch([text])[0] == library.encode(text, add_special_tokens=False).ids
    assert t.known and max(map(len, [*t.known, *t.stretches])) <= bpe.LONGEST


# ---- 8: embeddings

def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 16))
    x = np.concatenate([rng.standard_normal((150, 16)), *(c + rng.standard_normal((n, 16)) * 0.03 for c, n in zip(centres, [2] * 15 + [5, 40, 80, 120, 700], strict=True))]).astype(np.float32)
    label = [int(v) if v < 3 else None for v in rng.integers(0, 4, len(x))]
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    odd = [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [None] * 16, 0), (5003, [float("nan")] * 16, 0), (5004, [], 0), (5005, [1.0, 2.0], 0), (5006, [1.0, 2.0], 0), (None, x[0].tolist(), 99), (7, x[7].tolist(), 98)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("rid", F.lit("clash"))
    got = embed_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) + len(odd)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & np.array([[a is not None and a == b for b in label] for a in label])
    np.fill_diagonal(near, False)
    forest = common.Forest(len(x))
    forest.union(*np.nonzero(near))
    root = forest.flat()
    links = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None and r.vec_id != 7}
    for i in range(len(x)):
        if i != 7:
            assert links[i] == (near[i].sum(), root[i], root[i] == i)
    assert links[5005] == (1, 5005, True) and links[5006] == (1, 5005, False)
    assert all(links[k] == (0, k, True) for k in (5000, 5001, 5002, 5003, 5004))
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_behind_many_copies(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(32)
    base /= np.linalg.norm(base)
    off = rng.standard_normal((300, 32))
    off -= (off @ base)[:, None] * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    near = 0.982 * base + np.sqrt(1 - 0.982**2) * off
    x = np.concatenate([np.tile(base, (4000, 1)), near])
    df = spark.createDataFrame([(i, v.tolist(), "l") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    u = near / np.linalg.norm(near, axis=1, keepdims=True)
    own = (u @ u.T >= 0.98).sum(1) - 1
    assert got[0] == (4299, 0, True) and all(got[i] == (4299, 0, False) for i in range(1, 4000))
    assert all(got[4000 + i] == (4000 + own[i], 0, False) for i in range(300))


@pytest.mark.parametrize("block", [16, 4096])
def test_embedding_links_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "STRIP", 5)
    rng = np.random.default_rng(3)
    x = rng.standard_normal(8) + rng.standard_normal((120, 8)) * 0.1
    x[100:] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(120)] == ((u @ u.T >= 0.98).sum(1) - 1).tolist()


# ---- 9: mixing

def test_mixing(spark, documents):
    got = {r.doc_id: r for r in mixing.mixed(documents).collect()}
    rows = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in documents.collect()]
    total, own = sum(s for *_, s in rows), Counter()
    for _, source, s in rows:
        own[source] += s
    order = sorted(own, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target = {}
    while True:
        left = total - sum(3 * own[s] for s in target)
        share = {s: weight[s] * left / sum(weight[x] for x in order if x not in target) for s in order if s not in target}
        over = [s for s in share if share[s] > 3 * own[s]]
        if not over:
            break
        target |= {s: 3 * own[s] for s in over}
    target |= share
    taken = Counter()
    for key, source, s in rows:
        r = got[key]
        assert r.size == s and r.source_size == own[source] and r.target == pytest.approx(target[source])
        assert r.taken in {0, s, 2 * s, 3 * s}
        taken[source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], max(x for _, source, x in rows if source == s) / 2)
    again = {r.doc_id: r.taken for r in mixing.mixed(documents.repartition(7, "text")).collect()}
    assert again == {k: r.taken for k, r in got.items()}


def test_mixing_tree_keeps_totals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)
    monkeypatch.setattr(mixing, "FAN", 4)
    rng = random.Random(1)
    rows = [(i, f"s{min(i % 7, 3)}", rng.choice([0, 1, 5, 40, 300])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("payload", F.lit(None).cast("long"))
    got = mixing.copies(df, common.Scratch(spark, "test")).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 for r in got)
    for s in {r.source for r in got}:
        assert abs(sum(r.taken * r.size for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 40


def test_mixing_ranks_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 10)
    names = [f"s{i:03d}" for i in range(70)] + [None, "", "Z", "é", "😀", "\uffff"]
    df = spark.createDataFrame([(i, s, 10) for i, s in enumerate(names)], "doc_id long, source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df, common.Scratch(spark, "test")).collect()}
    order = sorted(names, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total = sum(weight.values())
    assert all(got[s] == pytest.approx(10 * len(names) * weight[s] / total) for s in names)


def test_mixing_does_not_depend_on_batches(spark):
    rng = random.Random(2)
    rows = [(i, f"s{i % 3}", rng.choice([1, 5, 40, 300])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("payload", F.lit(None).cast("long"))
    found = []
    for size in ("10000", "37"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted(mixing.copies(df, common.Scratch(spark, "test")).select("doc_id", "taken").collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_mixing_awkward(awkward):
    got = mixing.mixed(awkward).collect()
    assert len(got) == len(AWKWARD) and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mixed(awkward.limit(0)).count() == 0


# ---- 10: sharding

def check_shards(rows, got, tolerance):
    from zlib import crc32

    assert len(got) == len(rows)
    size = {}
    for r in got:
        size.setdefault(r.shard, []).append(r)
    for shard, own in size.items():
        assert 0 <= shard < 16 and sorted(r.slot for r in own) == list(range(len(own)))
    want = Counter((k, len((t or "").encode()) + 1, crc32((t or "").encode())) for k, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    if tolerance:
        sums = [sum(r.size for r in size.get(s, [])) for s in range(16)]
        assert max(sums) <= np.mean(sums) * (1 + tolerance) and min(sums) >= np.mean(sums) * (1 - tolerance)


def test_sharding(documents):
    got = sharding.sharded(documents).collect()
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check_shards(rows, got, 0.25)
    place = {r.doc_id: r.shard for r in got}
    groups = defaultdict(set)
    for k, t in rows:
        groups[t].add(place[k])
    assert all(len(s) == 1 for s in groups.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_sharding_many_small_and_a_hot_group(spark):
    rows = [(i, f"text number {i} " * (i % 9 + 1)) for i in range(6000)] + [(10_000 + i, "the hot text " * 4) for i in range(3000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(rows, got, 0.03)


def test_sharding_many_tiny_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SORTED", 500)
    rows = [(i, None if i % 3 == 0 else f"text number {i} " * 20) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.sharded(df).collect()
    check_shards(rows, got, 0.03)
    assert len({r.shard for r in got if r.doc_id % 3 == 0}) == 1  # equal texts stay together
    again = sorted(sharding.sharded(df.repartition(5, "text")).collect())
    assert [r.shard for r in sorted(got)] == [r.shard for r in again]


def test_sharding_awkward(awkward):
    got = sharding.sharded(awkward).collect()
    check_shards([(r[0], r[1]) for r in AWKWARD], got, None)
    assert sharding.sharded(awkward.limit(0)).count() == 0


# ---- the pipeline

def test_pipeline_stages(spark, documents, library):
    stages = dict(corpus_pipeline.STAGES)
    languages, dedup, mix, encode = stages.values()
    junk = spark.createDataFrame([(9001, "12 !!", "en", "src0", 5), (9002, None, "en", "src0", 0)], SCHEMA)
    one = languages(spark, documents.unionByName(junk), SF)
    assert one.columns == documents.columns
    assert {r.doc_id for r in one.select("doc_id").collect()} == {r.doc_id for r in documents.collect()}
    two = dedup(spark, one, SF)
    assert sorted(r.doc_id for r in two.collect()) == brute_survivors(sorted((r.doc_id, r.text) for r in one.collect()))
    two = common.Scratch(spark, "test").keep(two, "two")
    three = mix(spark, two, SF)
    want = {r.doc_id: r.taken for r in mixing.mixed(two).collect()}
    words = {r.doc_id: len((r.text or "").encode().split()) for r in two.collect()}
    have = Counter(r.doc_id for r in three.collect())
    assert {k: have[k] * words[k] for k in want} == want and three.columns == documents.columns
    texts = [(r.doc_id, r.text) for r in three.collect()]
    four = encode(spark, three, SF).collect()
    assert Counter((r.doc_id, sha(",".join(map(str, r.ids)))) for r in four) == Counter((k, sha(",".join(map(str, library.encode(t, add_special_tokens=False).ids)))) for k, t in texts)
    assert corpus_pipeline.run(spark, SF).count() > 0


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_survivors(rows):
    """Least id of each group of texts that five-word Jaccard similarities of 0.8 or more link."""
    sets, roots = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                roots[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted(least.values())


@pytest.mark.parametrize(("known", "few"), [(100_000, shingles.FEW), (0, shingles.FEW), (100_000, -1)])  # -1: all rounds of neighbours
def test_pipeline_drops_near_copies(spark, documents, monkeypatch, known, few):
    monkeypatch.setattr(shingles, "FREQUENT", known)
    monkeypatch.setattr(shingles, "FEW", few)
    rng = random.Random(5)
    texts = []
    for size in (4, 5, 9, 49, 50, 51, 200, 2000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        texts.append(words)
        # changed at the end, in the middle, often, and grown: similarities on both sides of 0.8
        texts += [[*words[:-1], "new"], [*words[: size // 2], "new", *words[size // 2 + 1 :]], [w if i % 25 else "new" for i, w in enumerate(words)], words + [f"x{i}" for i in range(size // 4)], words + [f"x{i}" for i in range(size // 5)]]
    rows = [(10_000 + i, " ".join(w)) for i, w in enumerate(texts)]
    planted = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], SCHEMA)
    docs = documents.unionByName(planted)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    rows += [(r.doc_id, r.text) for r in documents.collect()]
    assert left.columns == documents.columns
    assert sorted(r.doc_id for r in left.collect()) == brute_survivors(rows)


def test_pipeline_near_copies_awkward(spark, awkward):
    left = Counter(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, awkward, SF).collect())
    assert left == Counter({1: 1, 4: 1, 5: 1, 7: 1, 8: 1, 9: 1, None: 1})
    assert corpus_pipeline.drop_near_duplicates(spark, awkward.limit(0), SF).count() == 0


def test_small_buckets_are_left_to_the_last_round(spark):
    heads = [(1, 10, [7, 8]), (2, 10, [7, 9]), *((i, 10, [5]) for i in range(10, 10 + shingles.SMALL + 1)), (90, 10, [6])]
    met = shingles.buckets(spark.createDataFrame(heads, "key long, n int, head array<long>")).collect()
    # the size of its bucket goes with each row; before, all rows were joined with components in every round
    assert Counter((r.shingle, r.m) for r in met) == Counter({(7, 2): 2, (5, shingles.SMALL + 1): shingles.SMALL + 1})
