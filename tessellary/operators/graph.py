"""Graphs as edge tables (src, dst). Iterations cut their lineage in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from .knowledge import reading_minutes


def _cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def merged_edges(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """One row for each (src, dst) with the sum of weights, or the number of rows."""
    total = F.sum(weight) if weight else F.count(F.lit(1))
    return edges.groupBy("src", "dst").agg(total.alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) by distinct neighbours, of every node with an edge."""
    pairs = edges.select("src", "dst").distinct()
    ends = pairs.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(pairs.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def hubs(edges: DataFrame, least: int) -> DataFrame:
    """Nodes with ``least`` neighbours or more, in both directions together."""
    return degrees(edges).withColumn("degree", F.col("in_degree") + F.col("out_degree")).where(F.col("degree") >= least)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    used = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return nodes.select("id").join(used, "id", "left_anti")


def reachable(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(id, level): nodes that directed edges reach from ``start`` (id) and the least number of steps; start nodes are at 0."""
    seen = _cut(start.select("id").distinct().withColumn("level", F.lit(0)))
    frontier, level = seen, 0
    steps = edges.select(F.col("src").alias("id"), "dst").distinct()
    while (most is None or level < most) and not frontier.isEmpty():
        level += 1
        found = frontier.join(steps, "id").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = _cut(found.withColumn("level", F.lit(level)))
        seen = _cut(seen.union(frontier))
    return seen


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def shortest_paths(edges: DataFrame, start: object, most: int | None = None) -> DataFrame:
    """(id, path): an unweighted shortest path from ``start`` to every node that it reaches, in ``most`` steps at most if given, of equal ones the least by nodes."""
    steps = edges.select(F.col("src").alias("at"), "dst").distinct()
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    frontier = spark.range(1).select(F.lit(start).cast(kind).alias("id"), F.array(F.lit(start).cast(kind)).alias("path"))
    seen = frontier = _cut(frontier)
    level = 0
    while most is None or level < most:
        level += 1
        found = frontier.join(steps, F.col("id") == F.col("at")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        frontier = _cut(found.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        seen = _cut(seen.unionByName(frontier))
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected component, by least labels with pointer jumping."""
    links = _cut(undirected(edges))
    labels = _cut(links.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("component")))
    while True:
        near = links.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("near"))
        hooked = labels.join(near, F.col("id") == F.col("src")).select("id", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        jumped = hooked.join(up, "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component"), "before")
        jumped = _cut(jumped)
        labels = jumped.select("id", "component")
        if jumped.where("component <> before").isEmpty():
            return labels


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): every node takes the label most frequent among its neighbours, ties to the least, all at once, ``rounds`` times at most."""
    links = _cut(undirected(edges))
    labels = _cut(links.select(F.col("src").alias("id"), F.col("src").alias("community")).distinct())
    for _ in range(rounds):
        votes = links.join(labels, F.col("dst") == F.col("id")).groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b"))
        after = _cut(best.select(F.col("src").alias("id"), F.col("b.community").alias("community")))
        changed = after.join(labels.withColumnRenamed("community", "was"), "id").where("community <> was")
        labels, still = after, changed.isEmpty()
        if still:
            break
    return labels


def topological_levels(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, level): Kahn's levels; nodes without incoming edges are at 0, nodes on or behind a cycle are left out."""
    left = _cut(edges.select("src", "dst").distinct())
    nodes = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()
    out, level = None, 0
    while most is None or level < most:
        free = _cut(nodes.join(left.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        out = free if out is None else out.union(free)
        nodes = _cut(nodes.join(free, "id", "left_anti"))
        left = _cut(left.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    return out if out is not None else nodes.withColumn("level", F.lit(0)).limit(0)


def peeled(edges: DataFrame) -> DataFrame:
    """Edges that are left when nodes without incoming or without outgoing ones are taken off again and again."""
    left = _cut(edges.select("src", "dst").distinct())
    while True:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = _cut(kept.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if kept.count() == left.count():
            return kept
        left = kept


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): nodes of strongly connected components of two nodes or more, each named by its greatest node.

    By colouring: each round spreads the greatest id forward, then takes what reaches its own colour's root backward as one component, and goes on
    without it.
    """
    left = peeled(edges.where("src <> dst"))
    found = _cut(left.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0))
    while not left.isEmpty():
        colour = _cut(left.select(F.col("src").alias("id"), F.col("src").alias("c")).distinct())
        while True:
            comes = left.join(colour, F.col("src") == F.col("id")).groupBy("dst").agg(F.max("c").alias("m"))
            after = _cut(colour.join(comes, F.col("id") == F.col("dst"), "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("was")))
            colour, still = after.select("id", "c"), after.where("c <> was").isEmpty()
            if still:
                break
        a, b = colour.select(F.col("id").alias("src"), F.col("c").alias("ca")), colour.select(F.col("id").alias("dst"), F.col("c").alias("cb"))
        same = _cut(left.join(a, "src").join(b, "dst").where("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        members = reachable(same, colour.where("id = c").select("id")).select("id")
        # a root alone is no cycle: a component has an edge inside it
        inner = same.join(members.withColumnRenamed("id", "src"), "src", "left_semi").join(members.withColumnRenamed("id", "dst"), "dst", "left_semi")
        ends = inner.select(F.col("src").alias("id")).union(inner.select("dst")).distinct()
        found = _cut(found.union(ends.join(colour, "id").select("id", F.col("c").alias("component"))))
        rest = left.join(members.withColumnRenamed("id", "src"), "src", "left_anti").join(members.withColumnRenamed("id", "dst"), "dst", "left_anti")
        left = peeled(rest.select("src", "dst"))
    return found


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a directed cycle, those with an edge to themselves included."""
    loops = edges.where("src = dst").select(F.col("src").alias("id"))
    return loops.union(strong_components(edges).select("id")).distinct()


def cycle_paths(edges: DataFrame, longest: int, loops: bool = False) -> DataFrame:
    """(component, length, path, more): every cycle of at most ``longest`` nodes as the list of its nodes, from its least one back to it.

    Nodes are followed inside their strongly connected component only, and only to greater nodes than the first, so each cycle is found once and in
    one rotation. ``more`` says whether its component has paths that were given up at ``longest``; a component whose cycles are all longer has one
    row with neither path nor length. With ``loops`` an edge from a node to itself is a cycle of one. The number of cycles may grow
    with the power of ``longest``; they are the result, and no task gathers those of a component.
    """
    kind = edges.schema["src"].dataType.simpleString()
    part = strong_components(edges)
    a, b = part.select(F.col("id").alias("src"), "component"), part.select(F.col("id").alias("dst"), F.col("component").alias("other"))
    inner = edges.select("src", "dst").where("src <> dst").distinct().join(a, "src").join(b, "dst").where("component = other")
    inner = _cut(inner.select("component", F.col("src").alias("last"), "dst"))
    # a path needs a greater node behind its first one, so the last of a component begins none
    open_ = _cut(inner.where("dst > last").select("component", F.col("last").alias("first"), F.array("last", "dst").alias("path"), F.col("dst").alias("last")))
    closed = []
    for length in range(2, longest + 1):
        steps = open_.join(inner, ["component", "last"])
        found = steps.where(F.col("dst") == F.col("first")).select("component", F.lit(length).alias("length"), F.concat("path", F.array("first")).alias("path"))
        closed.append(_cut(found))
        ahead = steps.where((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst")))
        open_ = _cut(ahead.select("component", "first", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last")))
        if open_.isEmpty():
            break
    out = edges.where("src = dst and src is not null").select(F.col("src").alias("component"), F.lit(1).alias("length"), F.array("src", "dst").alias("path")).distinct()
    out = out if loops else out.where("false")
    for found in closed:
        out = out.unionByName(found)
    given_up = open_.select(F.col("component")).distinct().withColumn("more", F.lit(True))
    rows = out.join(given_up, "component", "left").withColumn("more", F.coalesce("more", F.lit(False)))
    bare = given_up.join(out.where("length > 1").select("component").distinct(), "component", "left_anti")
    return rows.unionByName(bare.select("component", F.lit(None).cast("int").alias("length"), F.lit(None).cast(f"array<{kind}>").alias("path"), "more"))


def depth_first(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, id, place, depth, parent): the order in which a depth-first walk from each entry (id) first comes to each node, children by ``rank``.

    A node's place in the walk is that of its least path, written as the ranks of its steps: every round hands on paths that have become less,
    and a node keeps its least one. So all entries walk at once, in as many rounds as the deepest path that is ever least has steps. Edges (src, dst,
    rank) of equal rank go by dst; an edge to a node that was met before leads nowhere. A path is as long as its node lies deep.
    """
    order = F.row_number().over(Window.partitionBy("src").orderBy("rank", "dst")).cast("int")
    steps = _cut(edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("rank").alias("rank")).select("src", "dst", order.alias("step")))
    start = entries.where("id is not null").select(F.col("id").alias("entry"), "id").distinct()
    kind = entries.schema["id"].dataType.simpleString()
    known = _cut(start.withColumn("key", F.expr("cast(array() as array<int>)")).withColumn("parent", F.lit(None).cast(kind)))
    changed = known
    while not changed.isEmpty():
        ahead = changed.join(steps, F.col("id") == F.col("src")).select("entry", F.col("dst").alias("id"), F.concat("key", F.array("step")).alias("key"), F.col("src").alias("parent"))
        best = ahead.groupBy("entry", "id").agg(F.min(F.struct("key", "parent")).alias("new"))
        both = _cut(known.join(best, ["entry", "id"], "full"))
        less = F.col("key").isNull() | (F.col("new.key") < F.col("key"))
        pick = lambda c: F.when(less, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
        changed = _cut(both.where(less).select("entry", "id", pick("key"), pick("parent")))
        known = _cut(both.select("entry", "id", pick("key"), pick("parent")))
    place = F.row_number().over(Window.partitionBy("entry").orderBy("key")) - 1
    return known.select("entry", "id", place.alias("place"), F.size("key").alias("depth"), "parent")


def flow_steps(edges: DataFrame, entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entry, place, id, next, is_exit): the steps of each entry's flow in depth-first order with what comes next after each: the node's own ``inner``
    names (nodes: id, inner), then the nodes that the walk first met from it. A step without a next one is an exit. Ids that ``nodes`` lacks aren't met."""
    known = nodes.select("id")
    inside = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    walk = _cut(depth_first(inside, entries.join(known, "id", "left_semi")))
    after = walk.where("parent is not null").groupBy("entry", F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("m"))
    rows = walk.join(after, ["entry", "id"], "left").join(nodes.select("id", "inner"), "id")
    names = lambda c: F.transform(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda x: x.cast("string"))
    following = F.concat(names("inner"), F.coalesce(F.transform("m", lambda x: x["id"].cast("string")), F.expr("cast(array() as array<string>)")))
    return rows.select("entry", "place", "id", following.alias("next"), (F.size(following) == 0).alias("is_exit"))


def parallel_groups(edges: DataFrame, items: DataFrame) -> DataFrame:
    """(groups): how many steps deep depth-first walks go that begin at all ``items`` (id) in order and go on to what they depend on, each item met once.

    Edges (src, dst, rank) lead from an item to those that it needs; one group if nothing depends on anything. No items, one group.
    """
    named = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("rank").cast("long").alias("rank"))
    ids = items.where("id is not null").select("id").distinct()
    place = F.row_number().over(Window.orderBy("id"))  # ids alone
    root = F.lit("\u0001")
    starts = ids.select(root.alias("src"), F.col("id").cast("string").alias("dst"), place.cast("long").alias("rank"))
    walk = depth_first(named.unionByName(starts), edges.sparkSession.range(1).select(root.alias("id")))
    return walk.agg(F.greatest(F.lit(1), F.max("depth")).alias("groups"))


def learning_path(edges: DataFrame, nodes: DataFrame, start: object, end: object) -> DataFrame:
    """(position, id, minutes, prerequisites, total_minutes, difficulty) of a shortest path, edges taken both ways; no rows if there is none.

    Nodes are (id, type, importance, stability). A path is advanced with a pattern, a decision, a deprecated node or a mean importance over 0.7, intermediate
    over 0.4, else for beginners.
    """
    way = shortest_paths(undirected(edges), start).where(F.col("id") == F.lit(end)).select(F.posexplode("path").alias("position", "id"))
    rows = way.join(nodes.select("id", "type", "importance", "stability"), "id").withColumn("minutes", reading_minutes(F.col("type"), F.col("importance")))
    whole = Window.partitionBy(F.lit(1))  # one path
    hard = F.max(F.coalesce(F.col("type").isin("pattern", "decision") | (F.col("stability") == "deprecated"), F.col("type").isin("pattern", "decision"), F.lit(False))).over(whole)
    mean = F.avg("importance").over(whole)
    level = F.when(hard | (mean > 0.7), "advanced").when(mean > 0.4, "intermediate").otherwise("beginner")
    before = F.lag("id").over(Window.orderBy("position"))
    needs = F.when(before.isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array(before.cast("string")))
    return rows.select("position", "id", "minutes", needs.alias("prerequisites"), F.sum("minutes").over(whole).alias("total_minutes"), level.alias("difficulty"))


def impact_chains(direct: DataFrame, indirect: DataFrame) -> DataFrame:
    """(root, items, length, severity) of each direct impact (path, level) and the indirect ones (path, level, affected_by: array) that name it.

    A chain has two items at least; it is high with one of high level, medium with two of medium, else low. Items are the root, then the rest by path.
    """
    follows = indirect.select("path", "level", F.explode(F.array_distinct("affected_by")).alias("root"))
    parts = follows.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("path", "level"))).alias("rest"))
    both = direct.select(F.col("path").alias("root"), F.col("level").alias("own")).join(parts, "root")
    levels = F.concat(F.array("own"), F.col("rest.level"))
    count = lambda level: F.size(F.filter(levels, lambda x: x == level))
    severity = F.when(count("high") > 0, "high").when(count("medium") > 1, "medium").otherwise("low")
    return both.select("root", F.concat(F.array("root"), F.col("rest.path")).alias("items"), F.size(levels).alias("length"), severity.alias("severity"))


def filtered(nodes: DataFrame, edges: DataFrame, keep, least_weight: float = 0.0) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Nodes that meet ``keep`` and edges of at least that weight both of whose ends are kept."""
    kept = nodes.where(keep)
    ends = kept.select("id")
    inside = edges.where(F.col("weight") >= least_weight)
    inside = inside.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inside


def cohesion(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(cluster, size, inside, cohesion): distinct directed edges within a cluster (id, cluster) over all that its size allows; 1 for a single member."""
    pairs = edges.select("src", "dst").where("src <> dst").distinct()
    a, b = (member.select(F.col("id").alias(c), F.col("cluster").alias(f"c{c}")) for c in ("src", "dst"))
    inside = pairs.join(a, "src").join(b, "dst").where("csrc = cdst").groupBy(F.col("csrc").alias("cluster")).agg(F.count(F.lit(1)).alias("inside"))
    sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    possible = F.col("size") * (F.col("size") - 1)
    both = sizes.join(inside, "cluster", "left").withColumn("inside", F.coalesce("inside", F.lit(0)).cast("long"))
    return both.withColumn("cohesion", F.when(possible > 0, F.col("inside") / possible).otherwise(F.lit(1.0)))


def best_per_key(rows: DataFrame, by: list[str], order: list) -> DataFrame:  # noqa: ANN001
    """The first row of each key in a stated order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")
