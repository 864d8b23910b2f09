"""Graphs of source code: imports, inheritance, calls, modules, and what a change of symbols touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import wordsets
from .graph import _cut

# Extensions that an import may leave out, in the order in which they are tried.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".java")
#: Classes with copies that are broadcast onto the sets; beyond that both are shuffled.
BROADCAST_ROWS = 100_000


def joined_path(base: Column, relative: Column) -> Column:
    """The directory of ``base`` and a relative path, with . and .. resolved."""
    parts = F.concat(F.slice(F.split(base, "/"), F.lit(1), F.size(F.split(base, "/")) - 1), F.split(relative, "/"))
    empty = F.expr("cast(array() as array<string>)")
    step = lambda s, p: F.when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).when(p == ".", s).otherwise(F.concat(s, F.array(p)))
    return F.array_join(F.aggregate(parts, empty, step), "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) for internal imports (path, source): the exact file, then one with an extension in order, then an index file."""
    wanted = imports.where(F.col("source").startswith(".")).select(F.col("path").alias("src"), "source", joined_path(F.col("path"), F.col("source")).alias("p"))
    endings = ("", *EXTENSIONS, *(f"/index{e}" for e in EXTENSIONS))
    tries = F.array(*(F.struct(F.lit(i).alias("rank"), F.concat("p", F.lit(e)).alias("path")) for i, e in enumerate(endings)))
    met = wanted.select("src", "source", F.explode(tries).alias("t")).select("src", "source", "t.rank", F.col("t.path").alias("path")).join(files.select("path"), "path")
    return met.groupBy("src", "source").agg(F.min(F.struct("rank", "path")).alias("b")).select("src", F.col("b.path").alias("dst")).distinct()


def first_definition(symbols: DataFrame) -> DataFrame:
    """(name, path, kind) of the first declaration of each name, by path and place."""
    best = symbols.groupBy("name").agg(F.min(F.struct("path", "ordinal", "kind")).alias("b"))
    return best.select("name", "b.path", "b.kind")


def inheritance(symbols: DataFrame) -> DataFrame:
    """(src, dst, type, weight, external): extends and implements edges between symbols; a parent nobody declares is external.

    An ``extends`` of an interface by a class counts as implementing it.
    """
    pairs = symbols.select("name", "kind", F.explode(F.concat(
        F.transform("extends", lambda x: F.struct(F.lit("extends").alias("type"), x.alias("parent"))), F.transform("implements", lambda x: F.struct(F.lit("implements").alias("type"), x.alias("parent"))),
    )).alias("e"))
    known = first_definition(symbols).select(F.col("name").alias("parent"), F.col("kind").alias("parent_kind"))
    edges = pairs.select(F.col("name").alias("src"), "kind", "e.type", "e.parent").join(known, "parent", "left")
    kind = F.when((F.col("parent_kind") == "interface") & (F.col("kind") != "interface"), "implements").otherwise(F.col("type"))
    return edges.select("src", F.col("parent").alias("dst"), kind.alias("type"), F.lit(2).alias("weight"), F.col("parent_kind").isNull().alias("external")).distinct()


def calls(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, n): functions whose lines name another declared function before a bracket; a file's own functions come first."""
    body = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    named = body.select("path", (F.col("at") + 1).alias("at"), F.explode(F.regexp_extract_all("text", F.lit(r"\b(\w+)\s*\("), F.lit(1))).alias("callee"))
    functions = symbols.where("kind = 'function'")
    inside = named.join(functions.select("path", F.col("name").alias("src"), "line", "end_line"), "path").where("at > line and at <= end_line")
    local = functions.select("path", F.col("name").alias("callee"), F.lit(True).alias("own")).distinct()
    anywhere = first_definition(functions.where("exported")).select(F.col("name").alias("callee"), F.col("path").alias("other"))
    met = inside.join(local, ["path", "callee"], "left").join(anywhere, "callee", "left").where("own or other is not null").where("callee <> src")
    return met.groupBy("src", F.col("callee").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def module_edges(edges: DataFrame) -> DataFrame:
    """File edges (src, dst) as edges of modules, with the number of file pairs as weight; edges inside a module are left out."""
    m = edges.select(tx.module_of(F.col("src")).alias("src"), tx.module_of(F.col("dst")).alias("dst"))
    return m.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind, name, change): symbols compared within their file by kind and name; the last of repeated ones counts."""
    keys = ["path", "kind", "name"]
    content = F.struct("line", "extends", "implements", "exported")
    side = lambda df, c: df.groupBy(*keys).agg(F.max_by(content.dropFields("line"), "ordinal").alias(c), F.lit(True).alias(f"has_{c}"))
    both = side(old, "a").join(side(new, "b"), keys, "full_outer")
    kind = F.when(F.col("has_a").isNull(), "added").when(F.col("has_b").isNull(), "deleted").otherwise("modified")
    return both.where(F.col("has_a").isNull() | F.col("has_b").isNull() | ~F.col("a").eqNullSafe(F.col("b"))).select(*keys, kind.alias("change"))


def declaration_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind, name, change): declarations that nothing holds, as ``declarations`` gives them, compared within their file by kind and name.

    One is modified if its signature, documentation, parameters, parents or anything of its direct members has changed, members' lines included; of
    repeated ones the last counts. Only what a file declares is gathered in one row.
    """
    keys = ["path", "kind", "name"]
    own = ["signature", "description", "documentation", "parameters", "extends", "implements"]
    inner = ["name", "kind", "line", "end_line", "type", "signature", "description", "parameters", "modifiers"]

    def side(df: DataFrame, name: str) -> DataFrame:
        members = df.where("parent is not null").groupBy("path", F.col("parent").alias("ordinal")).agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").alias("at"), F.to_json(F.struct(*inner)).alias("m")))).alias("m"))
        rows = df.where("parent is null").join(members.select("path", "ordinal", F.col("m.m").alias("members")), ["path", "ordinal"], "left")
        return rows.groupBy(*keys).agg(F.max_by(F.to_json(F.struct(*own, "members")), "ordinal").alias(name))

    both = side(old, "a").join(side(new, "b"), keys, "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return both.select(*keys, change.alias("change")).where("change is not null")


def listed(records: DataFrame, status: list[str] | None = None, tags: list[str] | None = None, by: str | None = None, start=None, end=None, text: str | None = None) -> DataFrame:  # noqa: ANN001
    """Decision records (id, status, tags, created_by, date, title, context, decision) that meet all given filters, newest first."""
    out = records
    if status:
        out = out.where(F.col("status").isin(*status))
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if by is not None:
        out = out.where(F.col("created_by") == by)
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end))
    if text:
        low = text.lower()
        out = out.where(F.lower("title").contains(low) | F.lower("context").contains(low) | F.lower("decision").contains(low))
    return out.orderBy(F.desc("date"), "id")


def knowledge_query(nodes: DataFrame, text: str, types: list[str] | None = None, members: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Nodes (id, type, title, description, tags, weight) that hold the text, of certain types and in certain clusters (members: id), heaviest first."""
    low = text.lower()
    out = nodes.where(F.lower("title").contains(low) | F.coalesce(F.lower("description").contains(low), F.lit(False)) | F.exists("tags", lambda t: F.lower(t).contains(low)))
    if types:
        out = out.where(F.col("type").isin(*types))
    if members is not None:
        out = out.join(members.select("id"), "id", "left_semi")
    return out.orderBy(F.desc("weight"), "id").limit(limit)


def _word_sets(items: DataFrame, key: str, text: str, *keep: Column) -> DataFrame:
    """``wordsets.coded`` of items with a key and words: id, ``keep``, bag (what equal word sets share), n, codes and rares."""
    words = F.coalesce(tx.word_set(F.col(text)), F.array().cast("array<string>"))
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *keep, words.alias("s"))
    return wordsets.coded(rows.withColumn("bag", F.md5(F.array_join(F.array_sort("s"), " ").cast("binary"))))


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bag, rep, members) of equal word sets, rep being the least id, and the ``_word_sets`` of the reps with members; sets stay where they are."""
    first = _cut(rows.groupBy("bag").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members")))
    many = first.where("members > 1")
    copied = F.broadcast(many) if many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else many
    distinct = rows.join(copied, "bag", "left").where("rep is null or rep = id")
    return first, distinct.select("id", "n", "codes", "rares", F.coalesce("members", F.lit(1)).cast("long").alias("members"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def similar_pairs(items: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """(a, b, jaccard) with a < b whose word sets have a Jaccard similarity over ``least``; every pair of like sizes is counted, none is shuffled before."""
    return _ordered(wordsets.pairs(_word_sets(items, key, text), least))


def similar_items(items: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """(a, b, jaccard) as ``similar_pairs``, over any number of copies: items of equal word sets are compared once, by their least key, and then take each other's place."""
    rows = _word_sets(items, key, text)
    first, distinct = _classes(rows)
    # (rep, id) of the others of a class; a set without copies takes no place but its own
    others = _cut(rows.select("id", "bag").join(first.where("members > 1"), "bag").where("id <> rep").select("rep", "id"))
    both = _cut(wordsets.pairs(distinct, least))
    for end in ("x", "y"):
        more = both.join(others.withColumnRenamed("rep", end), end).drop(end).withColumnRenamed("id", end)
        both = both.unionByName(more)
    member = others.union(others.select("rep", F.col("rep").alias("id")).distinct())
    x, y = member.select("rep", F.col("id").alias("x")), member.select("rep", F.col("id").alias("y"))
    copies = x.join(y, "rep").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("jaccard"))
    return _ordered(both).unionByName(copies)


def similar_classes(items: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """(id, class, n_links): for each item the least id among those of equal word sets, and how many other items its word set is over ``least`` like.

    Copies are one class and compared once, and their links are counted where they are found, never written as pairs; so the result has a row an item however
    many copies there are. Items without words and null texts have no class and no links; null keys are left out.
    """
    rows = _word_sets(items, key, text)
    first, distinct = _classes(rows)
    near = wordsets.links(distinct, least)
    of = first.withColumnRenamed("rep", "class").join(near.withColumnRenamed("id", "class"), "class", "left").select("bag", "class", (F.col("members") - 1 + F.coalesce("near", F.lit(0))).alias("n"))
    found = rows.select("id", "bag").join(of, "bag").select("id", "class", F.col("n").cast("long").alias("n_links"))
    wordless = items.where(F.col(key).isNotNull() & F.coalesce(F.size(tx.word_set(F.col(text))) <= 0, F.lit(True)))
    return found.unionByName(wordless.select(F.col(key).alias("id"), F.lit(None).cast(items.schema[key].dataType).alias("class"), F.lit(0).cast("long").alias("n_links")))


def consolidated(items: DataFrame, key: str, kind: str, text: str, order: Column, least: float) -> DataFrame:
    """(id, kept): items merged into a better one of their kind whose word sets are over ``least`` alike, greedily in the stated order, ties by key.

    An item survives if no survivor before it is alike; it then takes all that are left and alike. A survivor is settled in the round in which all before it that are alike are.
    """
    rows = _word_sets(items, key, text, F.col(kind).alias("kind"), order.alias("o"))
    # equal word sets have the same neighbours, so the first of them stands for all
    first = rows.groupBy("kind", "bag").agg(F.min(F.struct("o", "id")).alias("b")).select(F.col("kind").alias("k1"), F.col("bag").alias("b1"), F.col("b.id").alias("rep"))
    member = _cut(rows.select("id", "kind", "bag", "o").join(first, F.col("kind").eqNullSafe(F.col("k1")) & (F.col("bag") == F.col("b1"))).select("id", "rep", "kind", "o"))
    reps = _cut(member.where("id = rep").select("id", "kind", "o"))
    pairs = _ordered(wordsets.pairs(rows.join(reps.select("id"), "id", "left_semi"), least))
    x, y = reps.select(F.col("id").alias("a"), F.col("kind").alias("ka"), F.col("o").alias("oa")), reps.select(F.col("id").alias("b"), F.col("kind").alias("kb"), F.col("o").alias("ob"))
    met = pairs.join(x, "a").join(y, "b").where(F.col("ka").eqNullSafe(F.col("kb")))
    pa, pb = (F.struct(F.col(f"o{c}").alias("o"), F.col(c).alias("id")) for c in "ab")
    ahead = pa < pb
    left = _cut(met.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("worse"), F.least(pa, pb).alias("place")))
    merged = None
    while not left.isEmpty():
        # those with none before them survive; what they meet goes, to the first of them
        free = left.join(left.select(F.col("worse").alias("better")).distinct(), "better", "left_anti")
        gone = _cut(free.groupBy("worse").agg(F.min_by("better", "place").alias("kept")).select(F.col("worse").alias("id"), "kept"))
        merged = gone if merged is None else merged.unionByName(gone)
        rest = left.join(gone.select(F.col("id").alias("worse")), "worse", "left_anti")
        left = _cut(rest.join(gone.select(F.col("id").alias("better")), "better", "left_anti").select("better", "worse", "place"))
    ids = member.select("id", "rep")
    out = ids.where("id <> rep").select("id", F.col("rep").alias("kept"))
    if merged is None:
        return out
    moved = ids.join(merged.withColumnRenamed("id", "rep"), "rep", "left")
    return moved.where("id <> rep or kept is not null").select("id", F.coalesce("kept", "rep").alias("kept"))
