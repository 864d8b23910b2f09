"""What source files are for: intent, layer, design patterns; and knowledge items in comments and commit messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What names and texts say of a layer (the first counts) and of design patterns, and file names that say nothing.
LAYERS = (
    ("controller|handler|endpoint", "controller"), ("service|manager|facade", "service"), ("repository|dao|data|store", "repository"), ("model|entity|domain", "model"),
    ("util|helper|common", "utility"), ("middleware|interceptor|filter", "middleware"),
)
PATTERNS = (
    ("singleton|getInstance", "singleton"), ("factory|create[A-Z]", "factory"), (r"builder|with[A-Z]|build\(\)", "builder"), (r"observer|subscribe|emit|on\(", "observer"),
    ("strategy", "strategy"), ("adapter|adapt", "adapter"), ("decorator|wrap", "decorator"), ("proxy", "proxy"),
)
PLAIN = ("src", "lib", "dist", "index", "main", "app")
IMPORT = r"""import\s+(?:\{[^}]*\}|\*\s+as\s+\w+|\w+)\s+from\s+['"]([^'"]+)['"]"""
BLOCK, LINE = r"/\*\*?[\s\S]*?\*/", r"//[^\n\r]*"
PURPOSE = r"(?i)(?:provides?|handles?|manages?|implements?)\s+([^\n.]+)"


def layer(name: Column, content: Column) -> Column:
    """The first layer that a file's name or content speaks of, ``unknown`` without any."""
    out = F.lit("unknown")
    for pattern, of in reversed(LAYERS):
        out = F.when(name.rlike(f"(?i){pattern}") | content.rlike(f"(?i){pattern}"), of).otherwise(out)
    return out


def design_patterns(content: Column) -> Column:
    """Names of all design patterns that a text speaks of."""
    return F.array_compact(F.array(*(F.when(content.rlike(f"(?i){p}"), n) for p, n in PATTERNS)))


def intents(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(path, intent, layer, patterns, dependencies, secondary, confidence) of files (path, content); null content is empty.

    The intent is what the first comment (blocks before lines) says that the file provides, handles, manages or implements; else the telling parts of its name
    and the words of its first class, function or interface. ``symbols`` are declarations (path, ordinal, name, kind, documentation). Secondary
    intents are the words of its first five functions and methods. Confidence is 0.3, 0.2 more for an intent, for patterns, for symbols, and 0.1 for documentation.
    """
    name = F.substring_index("path", "/", -1)
    rows = files.select("path", F.coalesce("content", F.lit("")).alias("content"), name.alias("name"))
    if symbols is None:
        symbols = rows.where("false").select("path", F.lit(0).alias("ordinal"), F.lit("").alias("name"), F.lit("").alias("kind"), F.lit("").alias("documentation"))
    main = F.col("kind").isin("class", "function", "interface")
    called = F.when(F.col("kind").isin("method", "function"), F.struct("ordinal", "name"))
    # of a file's symbols only the first ones are kept as they are gathered
    of = symbols.groupBy("path").agg(
        F.min_by(F.when(main, F.col("name")), F.when(main, F.col("ordinal"))).alias("first"), F.count(F.lit(1)).alias("symbols"), F.bool_or(F.col("documentation").isNotNull() & (F.col("documentation") != "")).alias("documented"),
        F.slice(F.array_sort(F.collect_list(called)), 1, 5).alias("called"),
    )
    rows = rows.join(of, "path", "left")
    words = lambda c: F.filter(F.split(F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"), r"[\s_-]+"), lambda w: w != "")
    parts = F.filter(F.split(F.regexp_replace("name", r"\.[^.]+$", ""), "[._-]"), lambda p: ~F.lower(p).isin(*PLAIN))
    comments = F.concat(F.regexp_extract_all("content", F.lit(BLOCK), F.lit(0)), F.regexp_extract_all("content", F.lit(LINE), F.lit(0)))
    said = F.regexp_extract(F.coalesce(F.get(comments, F.lit(0)), F.lit("")), PURPOSE, 1)
    made = F.lower(F.array_join(F.concat(parts, F.coalesce(words(F.col("first")), F.expr("cast(array() as array<string>)"))), " "))
    intent = F.when(said != "", F.trim(said)).when(made != "", made).otherwise("unknown")
    rows = rows.select("*", intent.alias("intent"), layer(F.col("name"), F.col("content")).alias("layer"), design_patterns(F.col("content")).alias("patterns"))
    second = F.coalesce(F.transform("called", lambda x: F.array_join(words(x["name"]), " ")), F.expr("cast(array() as array<string>)"))
    point = lambda test, w: F.when(test, F.lit(w)).otherwise(F.lit(0.0))
    sure = F.lit(0.3) + point(F.col("intent") != "unknown", 0.2) + point(F.size("patterns") > 0, 0.2) + point(F.col("symbols") > 0, 0.2) + point(F.col("documented"), 0.1)
    found = F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1))
    return rows.select("path", "intent", "layer", "patterns", found.alias("dependencies"), second.alias("secondary"), F.least(F.lit(1.0), F.round(sure, 6)).alias("confidence"))


def layered(found: DataFrame) -> DataFrame:
    """(content, layers, confidence): what a project's layers (rows of ``intents``) say of its architecture; no row for fewer than two layers."""
    layers = found.where("layer <> 'unknown'").agg(F.array_sort(F.collect_set("layer")).alias("layers"))
    three = F.forall(F.array(F.lit("controller"), F.lit("service"), F.lit("repository")), lambda x: F.array_contains("layers", x))
    content = F.when(three, "layered architecture").otherwise(F.concat(F.lit("multiple layers: "), F.array_join("layers", ", ")))
    return layers.where(F.size("layers") >= 2).select(content.alias("content"), "layers", F.when(three, 0.85).otherwise(0.7).alias("confidence"))


def comment_items(files: DataFrame) -> DataFrame:
    """(path, type, content, confidence) of what line comments leave to do or to mend (0.7), and of blocks that give a decision or a reason (0.8, their
    first 500 characters without comment marks); in the order of the text within a type."""
    blocks = F.filter(F.regexp_extract_all("content", F.lit(r"/\*\*[\s\S]*?\*/"), F.lit(0)), lambda x: x.rlike("(?i)decision|because|rationale"))
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"/\*\*|\*/", ""), r"(?m)^\s*\*\s?", ""), r"^\s+|\s+$", "")
    reasons = F.transform(blocks, lambda x: _item("design-decision", F.substring(clean(x), 1, 500), 0.8))
    found = F.concat(_marked("todo", r"(?i)//\s*TODO:\s*([^\n\r]+)"), _marked("fixme", r"(?i)//\s*FIXME:\s*([^\n\r]+)"), reasons)
    return files.where("content is not null").select("path", F.explode(found).alias("i")).select("path", "i.type", "i.content", "i.confidence")


def document_items(docs: DataFrame) -> DataFrame:
    """(path, type, content, confidence) of documents: the section on architecture (0.9), that on the technology stack (0.85), and each heading that names a
    method and a path (0.9). A section ends before the next ## of any level."""
    section = lambda name: F.regexp_extract("content", rf"(?i)##\s*{name}[\s\S]*?(?=##|\z)", 0)
    whole = lambda kind, name, sure: F.when(section(name) != "", F.array(_item(kind, F.regexp_replace(section(name), r"^\s+|\s+$", ""), sure))).otherwise(F.filter(F.array(_item(kind, F.lit(""), sure)), lambda x: F.lit(False)))
    calls = F.regexp_extract_all("content", F.lit(r"(?i)##\s*((?:GET|POST|PUT|DELETE|PATCH)\s+/\S+)"), F.lit(1))
    named = F.transform(calls, lambda x: _item("api-documentation", F.regexp_replace(x, r"\s+", " "), 0.9))
    found = F.concat(whole("architecture", "Architecture", 0.9), whole("technology-stack", r"(?:Technology\s*)?Stack", 0.85), named)
    return docs.where("content is not null").select("path", F.explode(found).alias("i")).select("path", "i.type", "i.content", "i.confidence")


def _item(kind: str, content: Column, sure: float) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.trim(content).alias("content"), F.lit(sure).alias("confidence"))


def _marked(kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda x: _item(kind, x, 0.7))


def commit_items(messages: DataFrame, key: str, message: str) -> DataFrame:
    """(key, type, content, confidence) of messages on architecture (0.8), new features (0.7) and refactoring (0.6); one message may give two items."""
    low = F.lower(message)
    item = lambda test, kind, content, sure: F.when(test, F.struct(F.lit(kind).alias("type"), content.alias("content"), F.lit(sure).alias("confidence")))
    text = F.col(message)
    items = F.array_compact(F.array(
        item(low.contains("arch:") | low.contains("architecture"), "architectural-decision", text, 0.8),
        item(low.startswith("feat:") | low.startswith("feature:"), "feature-evolution", F.regexp_replace(text, r"(?i)^feat(ure)?:\s*", ""), 0.7),
        item(low.startswith("refactor:"), "refactoring", F.regexp_replace(text, r"(?i)^refactor:\s*", ""), 0.6),
    ))
    return messages.select(key, F.explode(items).alias("i")).select(key, "i.type", "i.content", "i.confidence")
