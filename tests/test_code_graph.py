"""Code graphs on a small source tree, and similarity joins against brute force."""

import random

from pyspark.sql import functions as F

from tessellary.operators import code_graph
from tessellary.sources import code

FILES = {
    "src/a/one.ts": "import { B } from '../b/two';\nimport { f } from './util';\nimport x from 'lib';\nexport class A extends B implements I {\n}\nexport function run() {\n  f(1);\n  help();\n}\n",
    "src/a/util.ts": "export function f(n) {\n  return g(n);\n}\nfunction g(n) { return n; }\n",
    "src/b/two.ts": "export interface I {}\nexport class B extends Outside {}\nexport class C extends I {}\n", "src/b/index.ts": "import { A } from '../a/one.ts';\nexport function help() {}\n",
}


def tables(spark):
    files = spark.createDataFrame([(p, "typescript", c) for p, c in FILES.items()], "path string, language string, content string")
    return files, code.symbols(files)


def test_imports_resolve(spark):
    files, _ = tables(spark)
    edges = code_graph.resolve_imports(code.imports(files), files)
    assert {(r.src, r.dst) for r in edges.collect()} == {("src/a/one.ts", "src/b/two.ts"), ("src/a/one.ts", "src/a/util.ts"), ("src/b/index.ts", "src/a/one.ts")}
    assert {(r.src, r.dst, r.weight) for r in code_graph.module_edges(edges).collect()} == {("a", "b", 1), ("b", "a", 1)}


def test_inheritance(spark):
    _, symbols = tables(spark)
    got = {(r.src, r.dst, r.type, r.external) for r in code_graph.inheritance(symbols).collect()}
    assert got == {("A", "B", "extends", False), ("A", "I", "implements", False), ("B", "Outside", "extends", True), ("C", "I", "implements", False)}


def test_calls(spark):
    files, symbols = tables(spark)
    assert {(r.src, r.dst) for r in code_graph.calls(symbols, files).collect()} == {("run", "f"), ("run", "help"), ("f", "g")}


def test_symbol_changes(spark):
    _, old = tables(spark)
    new = old.where("name <> 'g'").withColumn("extends", F.when(F.col("name") == "A", F.array(F.lit("Z"))).otherwise(F.col("extends")))
    assert {(r.name, r.change) for r in code_graph.symbol_changes(old, new).collect()} == {("g", "deleted"), ("A", "modified")}
    assert code_graph.symbol_changes(old, old).count() == 0


def test_records(spark):
    rows = [(1, "accepted", ["db"], "ann", "2024-01-01", "Use SQL", "", ""), (2, "proposed", ["ui"], "bob", "2024-02-01", "Buttons", "sql", ""), (3, "accepted", [], "ann", "2024-03-01", "Other", "", "")]
    adrs = spark.createDataFrame(rows, "id int, status string, tags array<string>, created_by string, date string, title string, context string, decision string")
    ids = lambda **k: [r.id for r in code_graph.listed(adrs, **k).collect()]
    assert ids() == [3, 2, 1] and ids(text="SQL") == [2, 1] and ids(status=["accepted"], by="ann") == [3, 1] and ids(tags=["ui", "x"]) == [2] and ids(start="2024-02-01", end="2024-02-28") == [2]
    nodes = spark.createDataFrame([("n", "class", "Parser", None, ["Text"], 1.0), ("m", "class", "Other", "parses", [], 2.0)], "id string, type string, title string, description string, tags array<string>, weight double")
    assert [r.id for r in code_graph.knowledge_query(nodes, "pars").collect()] == ["m", "n"]


def test_similar_pairs_are_all_found(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(rng.sample(words, rng.randint(0, 8)))) for i in range(150)] + [(900, "solo"), (901, "solo"), (902, None)]
    for least in (0.3, 0.5):
        got = {(r.a, r.b) for r in code_graph.similar_pairs(spark.createDataFrame(texts, "id int, text string"), "id", "text", least).collect()}
        sets = {i: set((t or "").split()) for i, t in texts}
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) > least * len(sets[a] | sets[b])}
        assert got == want


def test_similar_items_with_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.sample(words, rng.randint(0, 7))) for _ in range(60)]
    texts = [(i, t) for i, t in enumerate([*texts, *texts[:20], *(" ".join(reversed(t.upper().split())) for t in texts[:20])])] + [(900, None)]
    got = sorted((r.a, r.b) for r in code_graph.similar_items(spark.createDataFrame(texts, "id int, text string"), "id", "text", 0.3).collect())
    sets = {i: set((t or "").lower().split()) for i, t in texts}
    assert got == sorted((a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) > 0.3 * len(sets[a] | sets[b]))


def test_all_pairs_of_documents_are_compared(spark):
    from tessellary.plans import catalog

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = [(r.doc_id, set(r.text.lower().split())) for r in docs]
    want = {(i, j) for i, a in sets for j, b in sets if i < j and 10 * len(a & b) > 3 * len(a | b)}
    got = [(r.a, r.b) for r in catalog.queries()["word_jaccard_pairs"](spark, "/root/testdata/sf0.01").collect()]
    assert len(got) == len(want) and set(got) == want
    print("pairs", len(want))


def test_near_duplicates_are_merged_greedily(spark):
    from tessellary.plans import catalog

    rows = [(r.doc_id, r.source, r.text, r.n_chars) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    # a chain: each is alike to the next one only, so the second goes and the third survives
    base = [f"c{i}" for i in range(20)]
    rows += [(5000 + k, "chain", " ".join([*base[2 * k :], *(f"d{i}" for i in range(2 * k))]), 900 - k) for k in range(6)] + [(5010, "chain", "C0 c0 " + " ".join(base[1:]), 800), (5011, "other", " ".join(base), 700), (5012, None, " ".join(base), 3), (5013, None, " ".join(base), 4)]
    kept, want = [], {}
    for i, kind, text, n in sorted(rows, key=lambda r: (-r[3], r[0])):
        s = set((text or "").lower().split())
        for j, other, t in kept:
            if other == kind and s and len(s & t) * 10 > 8 * len(s | t):
                want[i] = j
                break
        else:
            kept.append((i, kind, s))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long")
    got = {r.id: r.kept for r in code_graph.consolidated(docs, "doc_id", "source", "text", -F.col("n_chars"), 0.8).collect()}
    assert got == want and want[5001] == 5000 and 5002 not in want and want[5012] == 5013
    whole = {r.id for r in catalog.queries()["consolidate_near_dupes"](spark, "/root/testdata/sf0.01").collect()}
    assert whole == {i for i in want if i < 5000}
    print("merged", len(whole))


def test_copies_are_counted_not_paired(spark):
    rows = [(i, "one two three four") for i in range(2000)] + [(3000, "ONE two three  four five"), (3001, "six"), (3002, ""), (3003, None), (None, "six")]
    got = {r.id: (r["class"], r.n_links) for r in code_graph.similar_classes(spark.createDataFrame(rows, "k long, t string"), "k", "t", 0.6).collect()}
    assert len(got) == 2004
    assert (got[0], got[1999], got[3000], got[3001], got[3002], got[3003]) == ((0, 2000), (0, 2000), (3000, 2000), (3001, 0), (None, 0), (None, 0))
