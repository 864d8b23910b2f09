"""Knowledge and commit operators on awkward rows: nulls, empty texts and tables, repeated rows, clashing columns."""

from pyspark.sql import functions as F

from tessellary.operators import commits, knowledge


def test_sections_of_awkward_texts(spark):
    rows = [(1, None), (2, ""), (3, "no heading"), (4, "before\n# A\ntext\n####### seven\n## B"), (4, "# A"), (None, "###### deep  \n\n x \n")]
    df = spark.createDataFrame(rows, "id int, content string").withColumn("order", F.lit("clash"))
    got = sorted(knowledge.sections(df, "id", "content").collect(), key=str)
    assert [(r.id, r.order, r.level, r.title) for r in got] == [(4, 0, 1, "A"), (4, 0, 1, "A"), (4, 1, 2, "B"), (None, 0, 6, "deep")]
    assert next(r.content for r in got if r.id is None) == "###### deep  \n\n x"
    assert knowledge.sections(df.limit(0), "id", "content").count() == 0


def test_term_positions(spark):
    df = spark.createDataFrame([("aAaaa",), ("",), (None,), ("x.y.",)], "t string")
    assert [r[0] for r in df.select(knowledge.term_positions(F.col("t"), "aa")).collect()] == [[0, 2], [], [], []]
    assert [r[0] for r in df.select(knowledge.term_positions(F.col("t"), ".")).collect()] == [[], [], [], [1, 3]]
    assert df.select(knowledge.term_positions(F.col("t"), "").alias("p")).first().p == []


def test_patterns_and_nodes(spark):
    df = spark.createDataFrame([(1, "Factory and factory"), (1, "Factory and factory"), (2, "factoryish factory"), (3, None)], "id int, content string")
    found = knowledge.patterns(df, "id", "content", {"factory": ("factory", "creator"), "other": ("nothing",)})
    assert [(r.id, r.pattern, r.hits) for r in found.collect()] == [(1, "factory", 2)] * 2
    assert [tuple(r) for r in knowledge.pattern_nodes(found, "id").collect()] == [("factory", 1, 0.3)]


def test_merge_keeps_null_content_out(spark):
    rows = [("k", 2, ["b", "a"], 3, 2, "two"), ("k", 1, ["a"], 5, 1, "one"), ("n", 1, None, 1, 1, None)]
    got = {r.k: r for r in knowledge.merged_sections(spark.createDataFrame(rows, "k string, at int, tags array<string>, priority int, level int, content string"), "k").collect()}
    assert (got["k"].tags, got["k"].priority, got["k"].level, got["k"].content) == (["a", "b"], 3, 1, "one\n\n---\n\ntwo")
    assert got["n"].content is None


def test_commit_bodies(spark):
    texts = [None, "fix: x", "fix: x\n\nA: 1\nplain\nB: 2", "fix: x\n\nbody\nA: 1\nBREAKING CHANGE: one\nbreaking-change: two\nB: 3\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, m string")
    got = {r.id: r for r in commits.with_body(df, "m").collect()}
    assert (got[1].body, got[1].footers, got[1].note) == (None, [], None)
    assert (got[2].body, [tuple(f) for f in got[2].footers]) == (None, [("A", "1"), ("B", "2")])
    assert (got[3].body, [tuple(f) for f in got[3].footers], got[3].breaking, got[3].note) == ("body\nA: 1", [("B", "3")], True, "two")


def test_invalidation_and_json(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", None), (None, ["y"])], "type string, tags array<string>")
    hits = lambda **k: [r[0] for r in df.select(knowledge.invalidated(df, **k)).collect()]
    assert hits() == [True] * 3 and hits(types=["a", "b"]) == [True, True, False] and hits(tags=["x", "y"]) == [True, False, True]
    texts = spark.createDataFrame([(None,), ("none",), ('a {"b": [1]} c',), ("[1, 2",), ("{broken}",)], "t string")
    assert [r[0] for r in texts.select(knowledge.json_in(F.col("t"))).collect()] == [None, None, '{"b": [1]}', None, None]
