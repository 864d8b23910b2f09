"""Pairs of nodes that are alike by tags, page, file and name. Nodes of one profile (type, tags, page, file) are compared once and take its place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

# What equal tags (times their Jaccard), one page, one file and a name that holds the other add.
TAGS, PAGE, FILE, NAME = 0.4, 0.3, 0.2, 0.1
#: Likeness is a sum of doubles; what differs by less may be equal.
SLACK = 1e-6
#: Nodes of a profile that are one row; larger profiles are several. Spark holds what two rows make, CHUNK x CHUNK pairs, at once.
CHUNK = 128
#: Profiles of several rows, at most a row for CHUNK nodes, that are broadcast onto the nodes; beyond that both are shuffled.
BROADCAST_ROWS = 100_000
#: Partitions of the pairs for each core.
SHARES = 8


def _profiles(nodes: DataFrame) -> DataFrame:
    """(uid, type, tags, page, file, members) of profiles in rows of about CHUNK ids; members: (name, ids). Tags are codes, from rare to frequent."""
    columns = [c for c in ("type", "page", "file") if c in nodes.columns]
    rows = nodes.where("id is not null").withColumn("tags", F.array_sort(F.array_distinct("tags")))
    rows = rows.withColumn("profile", F.to_json(F.struct(*columns, "tags")))
    many = graph._cut(rows.groupBy("profile").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).select("profile", F.ceil(F.col("n") / CHUNK).alias("parts")))
    many = F.broadcast(many) if many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else many
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).alias("part")
    own = [F.first(c).alias(c) for c in (*columns, "tags")]
    classes = rows.join(many, "profile", "left").select("profile", part, "name", "id", *columns, "tags").groupBy("profile", "part", "name").agg(F.collect_list("id").alias("ids"), *own)
    found = classes.groupBy("profile", "part").agg(F.collect_list(F.struct("name", "ids")).alias("members"), *own).drop("profile", "part")
    found = graph._cut(found).withColumn("uid", F.monotonically_increasing_id())
    each = found.select("uid", F.explode("tags").alias("t"))
    often = graph._cut(each.groupBy(F.col("t").alias("u")).agg(F.count(F.lit(1)).alias("n"))).withColumn("code", F.monotonically_increasing_id())
    ranked = each.hint("merge").join(often, F.col("t").eqNullSafe(F.col("u"))).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("n", "code")))["code"].alias("codes"))
    coded = found.drop("tags").hint("merge").join(ranked, "uid", "left")
    return coded.withColumn("tags", F.coalesce("codes", F.expr("cast(array() as array<bigint>)"))).drop("codes")


def pairs(nodes: DataFrame, sides: DataFrame | None, least: float, strict: bool, value: Callable[[Column, Column], Column] = lambda likeness, group: likeness) -> DataFrame:
    """(label, a, b, value) of the pairs of nodes (id, name, tags, page, file, and type if there are ``sides``) that are ``least`` (``strict``: over) alike, up to SLACK if not ``strict``.

    ``sides`` (type, group, label, begins, ends) says on which sides nodes of a type may stand; where both are of one type, a is the smaller id. Without it all meet all.
    ``value`` is made of likeness and group where profiles meet, once with and once without the part of names, never for each pair of nodes.
    Two profiles are met by what is equal of page and file, and there only, at their first common tag, rare ones first, or by names if they share none; so
    none has to be made distinct, and what alone doesn't reach ``least`` joins nobody alone. Sets of tags that must be alike meet at their rarest ones.
    """
    rows = _profiles(nodes)
    if sides is None:
        rows = rows.withColumns({"group": F.lit(""), "label": F.lit(""), "begins": F.lit(True), "ends": F.lit(True)})
    else:
        rows = rows.join(F.broadcast(sides), "type").drop("type")
    rows = rows.select("uid", "tags", "page", "file", "members", "group", "label", "begins", "ends")
    none = F.lit(None).cast("bigint")
    kinds = [(0, ()), (1, ("page",)), (2, ("file",)), (3, ("page", "file"))]

    def key(kind: int, equal: tuple[str, ...], **by: Column) -> Column:
        """What profiles are joined by that share the columns ``equal`` and a tag or name."""
        return F.struct(F.lit(kind).alias("equal"), F.to_json(F.struct("group", *equal, *(c.alias(name) for name, c in by.items()))).alias("key"), by.get("t", none).alias("t"))

    def by_tag(kind: int, equal: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda t: key(kind, equal, t=t)

    def has(equal: tuple[str, ...]) -> Column:
        out = F.lit(True)
        for c in equal:
            out = out & F.col(c).isNotNull()
        return out

    enough = lambda x: x > least if strict else x >= least - SLACK
    keyed: list[Column] = []
    alone: list[int] = []
    named: list[tuple[int, tuple[str, ...]]] = []
    n = F.size("tags")
    for kind, equal in kinds:
        base = PAGE * ("page" in equal) + FILE * ("file" in equal)
        if enough(base):
            keyed.append(F.when(has(equal), F.array(key(kind, equal))))
            alone.append(kind)
            continue
        if base + NAME >= least - SLACK:
            named.append((kind, equal))
        j = (least - base - NAME) / TAGS
        if j <= 1 + SLACK:
            # of n tags the first n - ceil(j * n) + 1, and with no bound on j all
            first = n - F.ceil(n * max(0.0, j - SLACK)).cast("int") + 1
            keyed.append(F.when(has(equal), F.transform(F.slice("tags", F.lit(1), F.least(n, first)), by_tag(kind, equal))))
    empty = F.lit(None).cast("array<struct<equal:int,key:string,t:bigint>>")
    placed = rows.withColumn("k", F.explode(F.flatten(F.array_compact(F.array(*keyed, empty)))))
    tasks = SHARES * nodes.sparkSession.sparkContext.defaultParallelism

    def side(df: DataFrame, at: str) -> DataFrame:
        mine = ("uid", "tags", "page", "file", "members", "begins", "ends")
        return df.select("k.key", *(["k.equal", "group", "label"] if at == "a" else []), F.col("k.t").alias(f"{at}_t"), *(F.col(c).alias(f"{at}_{c}") for c in mine)).repartition(tasks, "key")

    same = lambda c: F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False))
    common = F.array_intersect("a_tags", "b_tags")
    both_ways = F.col("a_ends") & F.col("b_begins")

    def scored(a: DataFrame, b: DataFrame, met: Column) -> DataFrame:
        """Profiles that meet, each two once, and the nodes in their places."""
        joined = side(a.where("begins"), "a").hint("merge").join(side(b.where("ends"), "b"), "key")
        equal = F.col("equal") == F.when(same("page"), 1).otherwise(0) + F.when(same("file"), 2).otherwise(0)
        joined = joined.where(~both_ways | (F.col("a_uid") <= F.col("b_uid"))).where(equal)
        joined = joined.withColumn("common", common).where(met)
        shared = F.size("common")
        union = F.size("a_tags") + F.size("b_tags") - shared
        likeness = F.when(union > 0, shared / union * TAGS).otherwise(0.0) + F.when(same("page"), PAGE).otherwise(0.0) + F.when(same("file"), FILE).otherwise(0.0)
        out = joined.select("group", "label", "a_members", "b_members", both_ways.alias("both"), (both_ways & (F.col("a_uid") == F.col("b_uid"))).alias("self"), likeness.alias("likeness"))
        values = [F.when(enough(x), value(F.least(F.lit(1.0), x), F.col("group"))).alias(c) for x, c in ((F.col("likeness"), "v0"), (F.col("likeness") + NAME, "v1"))]
        kept = ["label", "both", "self"]
        out = out.where(enough(F.col("likeness") + NAME)).select(*kept, *values, F.explode("a_members").alias("x"), "b_members")
        out = out.select(*kept, "v0", "v1", "x", F.explode("b_members").alias("y"))
        inside = F.contains("x.name", "y.name") | F.contains("y.name", "x.name")
        out = out.select(*kept, F.when(inside, F.col("v1")).otherwise(F.col("v0")).alias("value"), "x.ids", F.col("y.ids").alias("others")).where("value is not null")
        out = out.select(*kept, "value", F.explode("ids").alias("a"), "others").select(*kept, "value", "a", F.explode("others").alias("b"))
        out = out.where((F.col("a") != F.col("b")) & (~F.col("self") | (F.col("a") < F.col("b"))))
        turned = F.col("both") & (F.col("a") > F.col("b"))
        return out.select("label", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), "value")

    first = F.col("equal").isin(alone) if alone else F.lit(False)
    out = scored(placed, placed, first | (F.get("common", F.lit(0)) == F.col("a_t")))
    if named:
        # which of the names that occur hold which others, the empty one in all; then these are joined like keys
        given = rows.withColumn("m", F.explode("members")).where("m.name is not null").withColumns({"name": F.col("m.name"), "members": F.array("m")}).drop("m")
        names = given.select("name").distinct()
        length = F.length("name")
        inner = F.flatten(F.transform(F.sequence(F.lit(1), length), lambda m: F.transform(F.sequence(F.lit(1), length - m + 1), lambda i: F.substring("name", i, m))))
        inner = names.select(F.col("name").alias("whole"), F.explode(F.array_distinct(F.when(length == 0, F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), inner)))).alias("name"))
        held = graph._cut(inner.hint("merge").join(names, "name").select(F.col("whole").alias("name"), F.col("name").alias("held")))
        held = F.broadcast(held) if held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else held
        keys = lambda by: F.explode(F.flatten(F.array_compact(F.array(*(F.when(has(e), F.array(key(i, e, n=by))) for i, e in named)))))
        wholes, parts = given.join(held, "name").withColumn("k", keys(F.col("held"))), given.withColumn("k", keys(F.col("name")))
        for at_a, at_b in ((wholes, parts), (parts, wholes)):
            differ = F.lit(True) if at_a is wholes else F.get("a_members", F.lit(0))["name"] != F.get("b_members", F.lit(0))["name"]
            out = out.unionByName(scored(at_a, at_b, differ & (F.size("common") == 0)))
    return out
