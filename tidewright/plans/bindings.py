"""Bindings and counts on the network of nations: market segments are subgraphs, regions are parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import bindings, blocks, graph
from tidewright.plans.tables import NET_SQL, net, strong, strong_sql, table


def _bridges(spark, sf_dir):
    return blocks.blocks(strong(net(spark, sf_dir), 0.97))


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vertex"), F.col("n_regionkey").cast("long").alias("subgraph"), F.col("n_nationkey").cast("long").alias("local"))


def descend_once(spark, sf_dir):
    """Suppliers of each nation in the nation's one region."""
    counted = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("vertex")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return bindings.descended_once(counted, _nations(spark, sf_dir)).select("vertex", "subgraph", "n_suppliers")


def rebind_subgraphs(spark, sf_dir):
    """Readings of nations in every segment that has customers there."""
    members = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("subgraph"), F.lit("vertex").alias("binding_type"), F.col("c_nationkey").cast("long").alias("place"), F.col("c_nationkey").cast("long").alias("local")).distinct()
    seen = table(spark, sf_dir, "supplier").select(F.lit("vertex").alias("binding_type"), F.col("s_nationkey").cast("long").alias("place"), F.round("s_acctbal", 2).alias("value"))
    return bindings.rebound(seen, members).groupBy("subgraph", "place").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def rebind_to_flow(spark, sf_dir):
    """Region 0 has no flow: what is measured there goes to its nation that is in the part of the others, too."""
    parts = _nations(spark, sf_dir).select("subgraph", "vertex")
    shared = parts.filter("subgraph = 0").agg(F.min("vertex").alias("vertex")).select(F.lit(1).cast("long").alias("subgraph"), "vertex")
    seen = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("vertex"), "s_suppkey").join(parts, "vertex").select("subgraph", F.lit("vertex").alias("binding_type"), F.col("vertex").alias("place"), "s_suppkey")
    flowing = parts.filter("subgraph <> 0").select("subgraph").distinct()
    return bindings.rebound_to_flow(seen, parts.unionByName(shared), flowing)


def name_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.lit("vertex").alias("binding_type"), F.col("n_nationkey").cast("long").alias("place"), F.col("n_name").alias("name"))
    return bindings.named(graph.vertices(net(spark, sf_dir)).select(F.lit("vertex").alias("binding_type"), F.col("vertex").alias("place")), names)


def inverted_index(spark, sf_dir):
    """The last customer of each nation."""
    return bindings.inverted(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("index"), F.col("c_nationkey").cast("long").alias("value")))


def restored_order(spark, sf_dir):
    """Parts that were renumbered by name come back to their keys."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    numbered = graph.renumbered(parts.select(F.struct("p_name", "p_partkey").alias("by")), "by", "place").select("place", F.col("by.p_partkey").alias("original"))
    shuffled = parts.join(numbered, parts.p_partkey == numbered.original).select("place", F.round("p_retailprice", 2).alias("price"))
    return bindings.reordered(shuffled, numbered).select(F.col("place").alias("p_partkey"), "price")


def common_places(spark, sf_dir):
    """Nations that two market segments and a supplier in debt have in common."""
    customers = table(spark, sf_dir, "customer").filter("c_acctbal > 9000")
    a = customers.filter("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").cast("long").alias("vertex"))
    b = table(spark, sf_dir, "supplier").filter("s_acctbal < 2000").select(F.col("s_nationkey").cast("long").alias("vertex"))
    return bindings.common(a, b, "vertex")


def subgraph_edges(spark, sf_dir):
    found = bindings.edges_of_parts(net(spark, sf_dir), _nations(spark, sf_dir))
    return found.select("subgraph", F.size("edges").cast("long").alias("n_edges"), F.concat_ws(",", "edges").alias("edges"))


def block_places(spark, sf_dir):
    """Where readings on vertices and edges stand in the tree of blocks, as numbers of each kind."""
    blocked = _bridges(spark, sf_dir)
    seen = blocked.select(F.lit("edge2").alias("binding_type"), F.col("edge").alias("place")).unionByName(blocked.select(F.lit("vertex").alias("binding_type"), F.col("from_v").alias("place")).distinct())
    return bindings.bound_to_blocks(seen, blocked).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def vertex_blocks(spark, sf_dir):
    """(vertex, n_blocks) of every vertex; more than one at cut vertices only."""
    return bindings.blocks_of_vertices(_bridges(spark, sf_dir)).select("vertex", F.size("blocks").cast("long").alias("n_blocks"))


def block_kinds(spark, sf_dir):
    """Single-edge blocks are bridges; blocks without an edge of an even number are lumped."""
    blocked = _bridges(spark, sf_dir)
    kinds = blocked.select("edge", F.when(F.col("edge") % 2 == 0, "pipe").otherwise("valve").alias("kind"), F.when(F.col("edge") % 5 == 0, F.lit(None).cast("double")).otherwise(1.0).alias("flow"))
    joined = bindings.lumped_blocks(blocked, kinds).join(blocked.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("first")), "block")
    return joined.filter("n = 1").select(F.col("first").alias("edge"), "is_lumped", "is_propagatable")


def forest_blocks(spark, sf_dir):
    """Edges that were cut before come back as bridges."""
    edges = strong(net(spark, sf_dir), 0.95)
    cut = edges.filter("edge % 3 = 0").select("edge", "from_v", "to_v")
    whole = bindings.blocks_of_forest(blocks.blocks(edges.filter("edge % 3 <> 0")), cut)
    return whole.filter("edge % 3 = 0").select("edge", "block", "is_bridge")


def network_sizes(spark, sf_dir):
    return bindings.sizes(strong(net(spark, sf_dir), 0.5))


def port_vertices(spark, sf_dir):
    """Objects are nations with ports 1 and 2; a jumper joins the second of one to the first of another."""
    jumpers = strong(net(spark, sf_dir), 0.97).select(F.col("from_v").alias("from_object"), F.lit(2).cast("long").alias("from_port"), F.col("to_v").alias("to_object"), F.lit(1).cast("long").alias("to_port"))
    return bindings.ends_of_objects(bindings.ports_as_vertices(jumpers))


def ports_used(spark, sf_dir):
    jumpers = strong(net(spark, sf_dir), 0.9).select(F.col("from_v").alias("from_object"), F.lit(2).cast("long").alias("from_port"), F.col("to_v").alias("to_object"), F.lit(1).cast("long").alias("to_port"))
    return bindings.ports_in_use(jumpers)


def visited_ends(spark, sf_dir):
    edges = strong(net(spark, sf_dir), 0.9)
    return bindings.visited(graph.ends(edges), edges.filter("edge % 2 = 0").select("edge"), wanted=False)


def lumped_types(spark, sf_dir):
    states = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("is_opened"))
    return bindings.computed_as(states)


def filled_places(spark, sf_dir):
    """Every nation with the mean balance of all suppliers and of all customers."""
    means = table(spark, sf_dir, "supplier").agg(F.round(F.avg("s_acctbal"), 4).alias("value")).select(F.lit("supplier").alias("family"), "value").unionByName(table(spark, sf_dir, "customer").agg(F.round(F.avg("c_acctbal"), 4).alias("value")).select(F.lit("customer").alias("family"), "value"))
    return bindings.filled(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place")), means)


def vertex_sets(spark, sf_dir):
    """Ends of edges, edges at a subset of vertices, sorted lists at each vertex."""
    edges = strong(net(spark, sf_dir), 0.9)
    return graph.incidences(edges).select("vertex", F.concat_ws(",", "inlets").alias("inlets"), F.concat_ws(",", "outlets").alias("outlets"))


QUERIES = {
    f.__name__: f
    for f in (descend_once, rebind_subgraphs, rebind_to_flow, name_lookup, inverted_index, restored_order, common_places, subgraph_edges, block_places, vertex_blocks, block_kinds, forest_blocks, network_sizes, port_vertices, ports_used, visited_ends, lumped_types, filled_places, vertex_sets)
}

_SPLIT = f"""{strong_sql(0.97)}, vs AS (SELECT DISTINCT u AS vertex FROM both_ways)"""
#: An edge is a bridge if its ends part when it (with its parallels, of which it has none) is left out.
_BRIDGES = f"""WITH RECURSIVE {_SPLIT},
und AS (SELECT min(edge) AS edge, least(from_v, to_v) AS a, greatest(from_v, to_v) AS b, count(*) AS n FROM e GROUP BY 2, 3),
walk AS (SELECT edge, a AS at FROM und UNION SELECT walk.edge, w.v FROM walk JOIN both_ways w ON w.u = walk.at JOIN und ON und.edge = walk.edge WHERE NOT (least(w.u, w.v) = und.a AND greatest(w.u, w.v) = und.b)),
bridge AS (SELECT und.edge FROM und WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM walk WHERE walk.edge = und.edge AND walk.at = und.b))"""

ORACLES = {
    "descend_once": """
SELECT s_nationkey::BIGINT AS vertex, n_regionkey::BIGINT AS subgraph, count(*) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    "rebind_subgraphs": """
SELECT c_mktsegment AS subgraph, s_nationkey::BIGINT AS place, count(*) AS n, round(sum(round(s_acctbal, 2)), 2) AS total
FROM supplier JOIN (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer) ON c_nationkey = s_nationkey GROUP BY 1, 2""",
    "rebind_to_flow": """
SELECT CASE n_regionkey WHEN 0 THEN 1 ELSE n_regionkey END::BIGINT AS subgraph, 'vertex' AS binding_type,
       CASE n_regionkey WHEN 0 THEN (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 0) ELSE s_nationkey END::BIGINT AS place, s_suppkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "name_lookup": f"WITH {NET_SQL}, v AS (SELECT from_v AS v FROM net UNION SELECT to_v FROM net) SELECT 'vertex' AS binding_type, v AS place, n_name AS name FROM v JOIN nation ON n_nationkey = v",
    "inverted_index": "SELECT c_nationkey::BIGINT AS value, max(c_custkey) AS index FROM customer GROUP BY 1",
    "restored_order": "SELECT p_partkey, round(p_retailprice, 2) AS price FROM part",
    "common_places": """
SELECT c_nationkey::BIGINT AS vertex FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000 INTERSECT SELECT s_nationkey::BIGINT FROM supplier WHERE s_acctbal < 2000""",
    "subgraph_edges": f"""
WITH {NET_SQL} SELECT a.n_regionkey::BIGINT AS subgraph, count(*) AS n_edges, string_agg(edge, ',' ORDER BY edge) AS edges
FROM net JOIN nation a ON a.n_nationkey = from_v JOIN nation b ON b.n_nationkey = to_v AND a.n_regionkey = b.n_regionkey GROUP BY 1""",
    "block_places": f"{_BRIDGES} SELECT 'vertex' AS kind, count(DISTINCT from_v) AS n FROM e UNION ALL SELECT 'block', count(*) FROM bridge",
    "vertex_blocks": f"""
WITH RECURSIVE {_SPLIT},
walk AS (SELECT x.vertex AS without, y.vertex AS a, y.vertex AS b FROM vs x, vs y WHERE x.vertex <> y.vertex
         UNION SELECT without, a, v FROM walk JOIN both_ways ON u = b WHERE v <> without),
part AS (SELECT without, a, min(b) AS part FROM walk GROUP BY without, a)
SELECT without AS vertex, count(DISTINCT part) AS n_blocks FROM part JOIN both_ways ON u = without AND v = a GROUP BY without""",
    "block_kinds": f"{_BRIDGES} SELECT edge, edge % 2 <> 0 AS is_lumped, edge % 5 <> 0 AS is_propagatable FROM bridge",
    "forest_blocks": f"WITH {strong_sql(0.95)} SELECT edge, edge AS block, true AS is_bridge FROM e WHERE edge % 3 = 0",
    "network_sizes": f"""
WITH {strong_sql(0.5)} SELECT 0::BIGINT AS n_edges1, count(*) AS n_edges2, (SELECT count(DISTINCT u) FROM both_ways) AS n_vertices, max(greatest(from_v, to_v)) AS max_vertex FROM e""",
    "port_vertices": f"""
WITH RECURSIVE {strong_sql(0.97)},
j AS (SELECT from_v * 1048576 + 2 AS u, to_v * 1048576 + 1 AS v FROM e), b AS (SELECT u, v FROM j UNION SELECT v, u FROM j),
reach AS (SELECT u AS port, u AS root FROM b UNION SELECT b.v, reach.root FROM reach JOIN b ON b.u = reach.port),
parts AS (SELECT port, min(root) AS root FROM reach GROUP BY port), n AS (SELECT port, dense_rank() OVER (ORDER BY root) - 1 AS vertex FROM parts)
SELECT port // 1048576 AS object, max(vertex) FILTER (port % 1048576 = 1) AS from_v, max(vertex) FILTER (port % 1048576 = 2) AS to_v FROM n GROUP BY 1""",
    "ports_used": f"WITH {strong_sql(0.9)} SELECT from_v AS object, 2::BIGINT AS port, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT to_v, 1, count(*) FROM e GROUP BY 1",
    "visited_ends": f"WITH {strong_sql(0.9)} SELECT from_v AS vertex, edge, -1 AS incidence FROM e WHERE edge % 2 <> 0 UNION ALL SELECT to_v, edge, 1 FROM e WHERE edge % 2 <> 0",
    "lumped_types": "SELECT s_name AS name, s_acctbal > 0 AS is_opened, CASE WHEN s_acctbal > 0 THEN 'Instant' ELSE 'Splittable' END AS model_type FROM supplier",
    "filled_places": """
SELECT n_nationkey AS place, family, value, false AS confident FROM nation,
 (SELECT 'supplier' AS family, round(avg(s_acctbal), 4) AS value FROM supplier UNION ALL SELECT 'customer', round(avg(c_acctbal), 4) FROM customer)""",
    "vertex_sets": f"""
WITH {strong_sql(0.9)}, v AS (SELECT DISTINCT u AS vertex FROM both_ways)
SELECT vertex, coalesce((SELECT string_agg(edge, ',' ORDER BY edge) FROM e WHERE to_v = vertex), '') AS inlets,
       coalesce((SELECT string_agg(edge, ',' ORDER BY edge) FROM e WHERE from_v = vertex), '') AS outlets FROM v""",
}
