"""Intents, layers, patterns and knowledge items of source files and messages."""

from tessellary.operators import intents
from tessellary.sources import declarations

FILES = [
    ("src/user.service.ts", "/** Handles user sessions. Nothing else */\nimport { A } from './a';\nimport * as b from \"b\";\nclass UserService { getInstance() {} }\n// TODO: clean up\n//FIXME: leak \n"),
    ("src/orderList.ts", "/** x */\nexport class HTTPOrderList { loadAll() {} private keep_one() {} }"),
    ("lib/index.ts", None), ("a/cart.controller.ts", "let x = 1"), ("a/cart.repository.ts", ""),
]


def files(spark):
    return spark.createDataFrame([(p, c, "typescript", 0) for p, c in FILES], "path string, content string, language string, ordinal int")


def test_intents(spark):
    df = files(spark)
    got = {r.path: r for r in intents.intents(df, declarations.declarations(df)).collect()}
    service = got["src/user.service.ts"]
    assert (service.intent, service.layer, service.patterns, service.dependencies, service.secondary) == ("user sessions", "service", ["singleton"], ["./a", "b"], ["get Instance"])
    assert service.confidence == 1.0 or service.confidence == 0.9
    plain = got["src/orderList.ts"]
    assert (plain.intent, plain.layer, plain.patterns, plain.secondary, plain.confidence) == ("orderlist http order list", "unknown", [], ["load All", "keep one"], 0.8)
    assert (got["lib/index.ts"].intent, got["lib/index.ts"].confidence) == ("unknown", 0.3)
    assert (got["a/cart.controller.ts"].intent, got["a/cart.controller.ts"].layer) == ("cart controller", "controller")
    whole = intents.layered(intents.intents(df)).first()
    assert (whole.content, whole.confidence) == ("layered architecture", 0.85)
    assert intents.layered(intents.intents(df.where("path like 'src%'"))).collect() == []


def test_items_of_comments_and_messages(spark):
    got = [(r.type, r.content) for r in intents.comment_items(files(spark)).collect()]
    assert got == [("todo", "clean up"), ("fixme", "leak")]
    rows = spark.createDataFrame([(1, "feat: new architecture"), (2, "Feature: x"), (3, "refactor:  y"), (4, "fix: z"), (5, None)], "k int, m string")
    items = sorted((r.k, r.type, r.content, r.confidence) for r in intents.commit_items(rows, "k", "m").collect())
    assert items == [
        (1, "architectural-decision", "feat: new architecture", 0.8), (1, "feature-evolution", "new architecture", 0.7), (2, "feature-evolution", "x", 0.7), (3, "refactoring", "y", 0.6)]


def test_items_of_blocks_and_documents(spark):
    code = "/** Chosen because\n * it is fast. */\n/** plain */\n// TODO: later"
    text = "# Top\n## Architecture\nThree layers.\n\n## Technology Stack\nSpark\n## GET  /users/{id}\nx\n## post /users\n## Stacked\n"
    df = spark.createDataFrame([("c", code), ("d", text), ("n", None), ("e", "")], "path string, content string")
    got = [(r.type, r.content, r.confidence) for r in intents.comment_items(df.where("path = 'c'")).collect()]
    assert got == [("todo", "later", 0.7), ("design-decision", "Chosen because\nit is fast.", 0.8)]
    items = [(r.type, r.content, r.confidence) for r in intents.document_items(df.where("path <> 'c'")).collect()]
    assert items == [
        ("architecture", "## Architecture\nThree layers.", 0.9), ("technology-stack", "## Technology Stack\nSpark", 0.85), ("api-documentation", "GET /users/{id}", 0.9), ("api-documentation", "post /users", 0.9)]
