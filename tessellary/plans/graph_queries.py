"""Graphs over the star schema: the hierarchy region - nation - customer - order and the bipartite graph of parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from .registry import Tables, query

_TREE = """
    e AS (SELECT DISTINCT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
          UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier)"""
_SUPPLY = "e AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, count(*) AS weight FROM lineitem GROUP BY 1, 2)"


def _edge(df: DataFrame, a: str, src: str, b: str, dst: str) -> DataFrame:
    return df.select(F.concat(F.lit(a), src).alias("src"), F.concat(F.lit(b), dst).alias("dst"))


def tree(t: Tables) -> DataFrame:
    edges = _edge(t.nation, "R", "n_regionkey", "N", "n_nationkey").union(_edge(t.customer, "N", "c_nationkey", "C", "c_custkey"))
    return edges.union(_edge(t.supplier, "N", "s_nationkey", "S", "s_suppkey"))


def supply(t: Tables) -> DataFrame:
    return graph.merged_edges(_edge(t.lineitem, "P", "l_partkey", "S", "l_suppkey"))


@query("edge_weight_merge", f"WITH {_SUPPLY} SELECT * FROM e")
def edge_weight_merge(t: Tables) -> DataFrame:
    return supply(t)


@query("degree_hubs", f"""WITH {_SUPPLY}, d AS (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e)
    SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) + sum(i) AS BIGINT) AS degree FROM d GROUP BY id HAVING sum(o) + sum(i) >= 30""")
def degree_hubs(t: Tables) -> DataFrame:
    return graph.hubs(supply(t), 30)


@query("orphans", "SELECT 'C' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphans(t: Tables) -> DataFrame:
    nodes = t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("id"))
    return graph.orphans(nodes, _edge(t.orders, "C", "o_custkey", "O", "o_orderkey"))


_REACH = "r AS (SELECT 'R1' AS id, 0 AS level UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id)"


@query("reachability", f"WITH RECURSIVE {_TREE}, {_REACH} SELECT id, min(level) AS level FROM r GROUP BY id")
def reachability(t: Tables) -> DataFrame:
    return graph.reachable(tree(t), t.spark.createDataFrame([("R1",)], "id string"))


@query("dependents_reverse", f"""WITH RECURSIVE {_TREE}, r AS (SELECT 'C1' AS id, 0 AS level UNION SELECT e.src, r.level + 1 FROM r JOIN e ON e.dst = r.id) SELECT id, min(level) AS level FROM r GROUP BY id""")
def dependents_reverse(t: Tables) -> DataFrame:
    back = tree(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reachable(back, t.spark.createDataFrame([("C1",)], "id string"))


@query("k_hop_neighbors", f"""WITH RECURSIVE {_TREE}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    r AS (SELECT 'N3' AS id, 0 AS level UNION SELECT u.dst, r.level + 1 FROM r JOIN u ON u.src = r.id WHERE r.level < 2) SELECT id, min(level) AS level FROM r GROUP BY id""")
def k_hop_neighbors(t: Tables) -> DataFrame:
    return graph.reachable(graph.undirected(tree(t)), t.spark.createDataFrame([("N3",)], "id string"), 2)


@query("shortest_path", f"""WITH RECURSIVE {_TREE}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    r AS (SELECT 'R0' AS id, ['R0'] AS path UNION ALL SELECT u.dst, list_append(r.path, u.dst) FROM r JOIN u ON u.src = r.id WHERE NOT list_contains(r.path, u.dst))
    SELECT id, array_to_string(path, '>') AS path FROM r""")
def shortest_path(t: Tables) -> DataFrame:
    """Paths of a forest are unique, so all simple paths are the shortest ones."""
    return graph.shortest_paths(graph.undirected(tree(t)), "R0").select("id", F.array_join("path", ">").alias("path"))


@query("connected_components", f"""WITH RECURSIVE {_TREE}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
    r AS (SELECT id, id AS root FROM n WHERE id LIKE 'R%' UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.id),
    m AS (SELECT root, min(id) AS component FROM r GROUP BY root) SELECT id, component FROM r JOIN m USING (root)""")
def connected_components(t: Tables) -> DataFrame:
    return graph.components(tree(t))


@query("label_propagation", f"""WITH RECURSIVE {_TREE}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    n AS (SELECT DISTINCT src AS id FROM u),
    l AS (SELECT id, id AS community, 0 AS round FROM n
          UNION ALL SELECT id, community, round FROM (
            SELECT u.src AS id, l.community, l.round + 1 AS round, row_number() OVER (PARTITION BY u.src ORDER BY count(*) DESC, l.community) AS k
            FROM l JOIN u ON u.dst = l.id WHERE l.round < 3 GROUP BY u.src, l.community, l.round) WHERE k = 1)
    SELECT id, community FROM l WHERE round = 3""")
def label_propagation(t: Tables) -> DataFrame:
    return graph.label_propagation(tree(t), 3)


@query("label_propagation_whole", f"""WITH RECURSIVE {_TREE}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    n AS (SELECT DISTINCT src AS id FROM u),
    l AS (SELECT id, id AS community, 0 AS round FROM n
          UNION ALL SELECT id, community, round FROM (
            SELECT u.src AS id, l.community, l.round + 1 AS round, row_number() OVER (PARTITION BY u.src ORDER BY count(*) DESC, l.community) AS k
            FROM l JOIN u ON u.dst = l.id WHERE l.round < 10 GROUP BY u.src, l.community, l.round) WHERE k = 1)
    SELECT id, community FROM l WHERE round = 10""")
def label_propagation_whole(t: Tables) -> DataFrame:
    """Up to 10 rounds, or until nothing changes."""
    return graph.label_propagation(tree(t))


@query("topo_levels", f"WITH RECURSIVE {_TREE}, r AS (SELECT DISTINCT src AS id, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id) SELECT id, max(level) AS level FROM r GROUP BY id")
def topo_levels(t: Tables) -> DataFrame:
    return graph.topological_levels(tree(t))


_MODULES = """m AS (SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer c ON c_custkey = o_custkey
    JOIN supplier s ON s_suppkey = l_suppkey)"""


@query("cycle_nodes", f"WITH RECURSIVE {_MODULES}, r AS (SELECT src AS a, dst AS b FROM m UNION SELECT r.a, m.dst FROM r JOIN m ON r.b = m.src) SELECT DISTINCT a AS id FROM r WHERE a = b")
def cycle_nodes(t: Tables) -> DataFrame:
    """Nations that trade in a circle."""
    return graph.cycle_nodes(trade(t))


@query("graph_filter", f"""WITH {_SUPPLY}, n AS (SELECT 'P' || p_partkey AS id FROM part WHERE p_size <= 25 UNION ALL SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0)
    SELECT src, dst, weight FROM e WHERE weight >= 2 AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def graph_filter(t: Tables) -> DataFrame:
    parts = t.part.select(F.concat(F.lit("P"), "p_partkey").alias("id"), (F.col("p_size") <= 25).alias("keep"))
    nodes = parts.union(t.supplier.select(F.concat(F.lit("S"), "s_suppkey"), F.col("s_acctbal") > 0))
    return graph.filtered(nodes, supply(t), F.col("keep"), 2)[1].select("src", "dst", "weight")


@query("cluster_cohesion", """
    WITH e AS (SELECT DISTINCT o1.o_custkey AS a, o2.o_custkey AS b FROM orders o1 JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1 WHERE o1.o_custkey <> o2.o_custkey),
    i AS (SELECT x.c_nationkey AS cluster, count(*) AS inside FROM e JOIN customer x ON x.c_custkey = a JOIN customer y ON y.c_custkey = b WHERE x.c_nationkey = y.c_nationkey GROUP BY 1),
    s AS (SELECT c_nationkey AS cluster, count(*) AS size FROM customer GROUP BY 1)
    SELECT cluster, size, coalesce(inside, 0) AS inside, round(CASE WHEN size < 2 THEN 1.0 ELSE coalesce(inside, 0) / (size * (size - 1)) END, 6) AS cohesion FROM s LEFT JOIN i USING (cluster)""")
def cluster_cohesion(t: Tables) -> DataFrame:
    """Customers of successive orders are linked, nations are clusters."""
    a = t.orders.select((F.col("o_orderkey") + 1).alias("k"), F.col("o_custkey").alias("src"))
    edges = a.join(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("dst")), "k")
    member = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster"))
    return graph.cohesion(edges.select("src", "dst"), member).withColumn("cohesion", F.round("cohesion", 6))


@query("module_cohesion", """
    WITH m AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
    SELECT src AS module, CAST(sum(CASE WHEN src = dst THEN weight ELSE 0 END) AS BIGINT) AS inside, CAST(sum(weight) AS BIGINT) AS total, round(sum(CASE WHEN src = dst THEN weight ELSE 0 END) / sum(weight), 6) AS cohesion,
           count(*) FILTER (src <> dst) AS dependencies FROM m GROUP BY src""")
def module_cohesion(t: Tables) -> DataFrame:
    named = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    named = named.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("src")), F.col("c_custkey") == F.col("o_custkey"))
    named = named.join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("s_suppkey") == F.col("l_suppkey"))
    m = graph.merged_edges(named.select("src", "dst"))
    inside = F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0))
    return m.groupBy(F.col("src").alias("module")).agg(
        inside.alias("inside"), F.sum("weight").alias("total"), F.round(inside / F.sum("weight"), 6).alias("cohesion"), F.count_if(F.col("src") != F.col("dst")).alias("dependencies")
    )


@query("recommend_scores", """
    WITH recent AS (SELECT DISTINCT l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7),
    sup AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_partkey IN (SELECT p FROM recent)),
    s AS (SELECT l_partkey AS id, 0.5 AS x FROM lineitem WHERE l_suppkey IN (SELECT s FROM sup) GROUP BY 1 UNION ALL SELECT p, 0.3 FROM recent UNION ALL SELECT p_partkey, 0.4 FROM part WHERE p_type LIKE '%PROMO%' OR contains(lower(p_name), 'red')
          UNION ALL SELECT p_partkey, 0.2 * p_size / 50.0 FROM part WHERE p_size > 35)
    SELECT id, round(sum(x), 6) AS score FROM s GROUP BY id ORDER BY sum(x) DESC, id LIMIT 10""")
def recommend_scores(t: Tables) -> DataFrame:
    orders = t.orders.where("o_custkey = 7").select(F.col("o_orderkey").alias("l_orderkey"))
    recent = t.lineitem.join(orders, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("id")).distinct()
    sup = t.lineitem.join(recent.select(F.col("id").alias("l_partkey")), "l_partkey", "left_semi").select("l_suppkey").distinct()
    related = t.lineitem.join(sup, "l_suppkey", "left_semi").select(F.col("l_partkey").alias("id")).distinct()
    found = t.part.where(F.col("p_type").contains("PROMO") | F.lower("p_name").contains("red")).select(F.col("p_partkey").alias("id"))
    heavy = t.part.where("p_size > 35").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 0.2 / 50.0).alias("x"))
    scored = related.withColumn("x", F.lit(0.5)).union(recent.withColumn("x", F.lit(0.3))).union(found.withColumn("x", F.lit(0.4))).union(heavy)
    return scored.groupBy("id").agg(F.sum("x").alias("s")).orderBy(F.desc("s"), "id").limit(10).select("id", F.round("s", 6).alias("score"))


@query("indirect_impact", """
    WITH direct AS (SELECT l_suppkey AS page, 0 AS hop, min(l_orderkey) AS via FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1),
    ind AS (SELECT s2.s_suppkey AS page, 1 AS hop, min(d.page) AS via FROM direct d JOIN supplier s1 ON s1.s_suppkey = d.page JOIN supplier s2 ON s2.s_nationkey = s1.s_nationkey GROUP BY 1)
    SELECT page, min(hop) AS hop, arg_min(via, hop) AS via FROM (SELECT * FROM direct UNION ALL SELECT * FROM ind) GROUP BY page""")
def indirect_impact(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    direct = t.lineitem.join(urgent, "l_orderkey").groupBy(F.col("l_suppkey").alias("page")).agg(F.lit(0).alias("hop"), F.min("l_orderkey").alias("via"))
    home = t.supplier.select(F.col("s_suppkey").alias("page"), "s_nationkey")
    near = direct.join(home, "page").groupBy("s_nationkey").agg(F.min("page").alias("via"))
    indirect = t.supplier.join(near, "s_nationkey").select(F.col("s_suppkey").alias("page"), F.lit(1).alias("hop"), "via")
    return graph.best_per_key(direct.union(indirect), ["page"], ["hop"])


def trade(t: Tables) -> DataFrame:
    """A row for each line: the buyer's nation (src) and the seller's (dst)."""
    named = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    named = named.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("src")), F.col("c_custkey") == F.col("o_custkey"))
    return named.join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("s_suppkey") == F.col("l_suppkey")).select("src", "dst")


@query("cycle_paths", f"""WITH RECURSIVE {_MODULES}, r AS (SELECT src AS first, dst AS last, [src, dst] AS path FROM m WHERE src < dst
      UNION ALL SELECT first, m.dst, path || [m.dst] FROM r JOIN m ON m.src = r.last WHERE m.dst > first AND NOT list_contains(path, m.dst) AND len(path) < 4),
    g AS (SELECT src AS a, dst AS b FROM m UNION SELECT g.a, m.dst FROM g JOIN m ON g.b = m.src),
    s AS (SELECT x.a AS id, max(x.b) AS component FROM g x JOIN g y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
    c AS (SELECT s.component, CAST(len(path) AS INT) AS length, path || [first] AS path FROM r JOIN m ON m.src = r.last AND m.dst = r.first JOIN s ON s.id = r.first WHERE len(path) <= 3),
    o AS (SELECT DISTINCT s.component FROM r JOIN s ON s.id = r.first JOIN s z ON z.id = r.last AND z.component = s.component WHERE len(path) = 4)
    SELECT component, length, array_to_string(path, '-') AS path, component IN (FROM o) AS more FROM c""")
def cycle_paths(t: Tables) -> DataFrame:
    """Circles of two or three trading nations."""
    return graph.cycle_paths(trade(t), 3).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "-"))


@query("depth_first_flow", """
    WITH RECURSIVE n AS (SELECT c.c_nationkey AS src, s.s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer c ON c_custkey = o_custkey
           JOIN supplier s ON s_suppkey = l_suppkey WHERE c.c_nationkey <> s.s_nationkey GROUP BY ALL),
    e AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rank FROM n QUALIFY rank <= 2),
    w AS (SELECT n_nationkey AS entry, n_nationkey AS id, CAST([] AS BIGINT[]) AS key, [n_nationkey] AS path FROM nation WHERE n_regionkey = 1
          UNION ALL SELECT entry, e.dst, key || [e.rank], path || [e.dst] FROM w JOIN e ON e.src = w.id WHERE NOT list_contains(path, e.dst)),
    b AS (SELECT entry, id, min(key) AS key, arg_min(path, key) AS path FROM w GROUP BY entry, id)
    SELECT entry, id, CAST(row_number() OVER (PARTITION BY entry ORDER BY key) - 1 AS INT) AS place, CAST(len(key) AS INT) AS depth, path[len(path) - 1] AS parent FROM b""")
def depth_first_flow(t: Tables) -> DataFrame:
    """Depth-first walks from a region's nations, each nation leading to the two that it buys from most."""
    counted = trade(t).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    ranked = graph.best_per_key(counted, ["src"], [F.desc("n"), F.col("dst")]).withColumn("rank", F.lit(1))
    second = graph.best_per_key(counted.join(ranked.select("src", "dst"), ["src", "dst"], "left_anti"), ["src"], [F.desc("n"), F.col("dst")]).withColumn("rank", F.lit(2))
    edges = ranked.unionByName(second).select("src", "dst", "rank")
    return graph.depth_first(edges, t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("id")))
