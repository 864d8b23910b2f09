"""Decision records from comments, commits and documents; chains, groups and learning paths."""

from tessellary.operators import decisions, graph

CODE = """
/**
 * @decision Use TypeScript and React for frontend
 * @why One language
 * @alternative Plain scripts
 * @consequence Positive: fewer faults
 */
function init() {}
// ordinary
x() // @decision not at the line's beginning
# We decided to keep it. For now
  /* DECISION: cache
     Impact: more memory */
/* never closed @decision Nothing
"""


def test_comments_of_code(spark):
    df = spark.createDataFrame([("a.ts", CODE, 1), ("b.ts", None, 1), ("c.ts", "plain()", 1)], "path string, content string, first int")
    got = {r.first: r for r in decisions.from_code(df).collect()}
    assert sorted(got) == [2, 11, 12]
    block = got[2]
    assert (block.last, block.title, block.why, block.alternatives, block.topics) == (7, "Use TypeScript and React for frontend", "One language", "Plain scripts", ["typescript", "react"])
    assert (block.effects.positive, block.effects.neutral, block.confidence) == (["Positive: fewer faults"], [], 1.0)
    assert (got[11].title, got[11].decision, got[11].confidence) == ("We decided to keep it", "We decided to keep it. For now", 0.7)
    assert (got[12].title, got[12].effects.neutral, got[12].confidence) == ("cache", ["more memory"], 0.6)


def test_commit_messages(spark):
    rows = [
        (1, "feat(auth): add token design\n\nText\n\nWhy: sessions were lost too often\n\nmore"), (2, "fix: repair"), (3, "docs: describe the decision"), (4, "We migrated to a new queue"),
        (5, "update"), (6, None), (7, ""), (8, "Refactor: move\n\nreason none"),
    ]
    got = {r.k: r for r in decisions.from_commits(spark.createDataFrame(rows, "k int, m string"), "k", "m").collect()}
    assert {k: (r.title, r.decision, r.context, r.confidence) for k, r in got.items()} == {
        1: ("[auth] add token design", "add token design", "sessions were lost too often", 0.85), 3: ("describe the decision", "describe the decision", "", 0.7),
        4: ("We migrated to a new queue", "We migrated to a new queue", "", 0.7),
    }
    assert got[1].topics == ["design"]


def test_document_sections(spark):
    text = "intro\n# Design Decision\nWe selected a database.\nConsequences: Benefit of speed\n\n## Other\nWe selected nothing\n## Architecture\nplain"
    got = decisions.from_documents(spark.createDataFrame([(1, text), (2, None)], "k int, c string"), "k", "c").collect()
    assert [(r.title, r.effects.positive, r.topics, r.confidence) for r in got] == [("Design Decision", ["Benefit of speed"], ["database"], 0.8)]
    assert got[0].decision.startswith("We selected")


def test_impact_chains(spark):
    direct = spark.createDataFrame([("a", "low"), ("b", "medium"), ("c", "low")], "path string, level string")
    indirect = spark.createDataFrame([("x", "medium", ["a", "b", "a"]), ("y", "high", ["a"]), ("z", "low", [])], "path string, level string, affected_by array<string>")
    got = {r.root: (r["items"], r.length, r.severity) for r in graph.impact_chains(direct, indirect).collect()}
    assert got == {"a": (["a", "x", "y"], 3, "high"), "b": (["b", "x"], 2, "medium")}


def test_parallel_groups(spark):
    items = spark.createDataFrame([("b1",), ("b2",), ("b3",)], "id string")
    edges = lambda *rows: spark.createDataFrame([(a, b, 0) for a, b in rows], "src string, dst string, rank int")
    assert graph.parallel_groups(edges(), items).first().groups == 1
    assert graph.parallel_groups(edges(("b1", "b2"), ("b2", "b3")), items).first().groups == 3
    assert graph.parallel_groups(edges(("b3", "b2"), ("b2", "b1")), items).first().groups == 1  # all are met before they are needed


def test_learning_path(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d")], "src string, dst string")
    nodes = spark.createDataFrame([("a", "concept", 0.5, None), ("b", "api", 0.5, "stable"), ("c", "page", 0.4, None), ("d", "pattern", 0.1, None)], "id string, type string, importance double, stability string")
    got = [tuple(r) for r in graph.learning_path(edges, nodes, "a", "c").orderBy("position").collect()]
    assert got == [(0, "a", 18, [], 76, "intermediate"), (1, "b", 33, ["a"], 76, "intermediate"), (2, "c", 25, ["b"], 76, "intermediate")]
    assert {r.difficulty for r in graph.learning_path(edges, nodes, "a", "d").collect()} == {"advanced"}
    assert graph.learning_path(edges, nodes, "a", "q").collect() == []
