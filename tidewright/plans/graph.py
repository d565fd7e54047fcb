"""Graph operators on the network of nations that ship to each other."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.operators import graph
from tidewright.plans.tables import NET_SQL, net, strong, strong_sql, table


def _strong(spark, sf_dir, share):
    return strong(net(spark, sf_dir), share)


def vertex_degree_ranked(spark, sf_dir):
    return graph.degrees(_strong(spark, sf_dir, 0.9), 5)


def source_sink_vertices(spark, sf_dir):
    edges = _strong(spark, sf_dir, 0.95)
    return graph.source_vertices(edges).withColumn("kind", F.lit("source")).union(graph.sink_vertices(edges).withColumn("kind", F.lit("sink")))


def incidence_coo(spark, sf_dir):
    return graph.ends(_strong(spark, sf_dir, 0.5))


def reduced_incidence_split(spark, sf_dir):
    return graph.split_incidences(_strong(spark, sf_dir, 0.5), 20)


def orient_by_flow(spark, sf_dir):
    pairs = net(spark, sf_dir).filter("from_v <> to_v")
    low, high = F.least("from_v", "to_v"), F.greatest("from_v", "to_v")
    netted = pairs.groupBy(low.alias("from_v"), high.alias("to_v")).agg(F.sum(F.when(F.col("from_v") < F.col("to_v"), F.col("flow")).otherwise(-F.col("flow"))).alias("flow"))
    return graph.oriented(netted).withColumn("flow", F.round("flow", 3))


def components_threshold(spark, sf_dir):
    return graph.components(net(spark, sf_dir).filter("from_v <> to_v").join(_strong(spark, sf_dir, 0.97).select("edge", F.lit(True).alias("kept")), "edge", "left"), F.col("kept"))


def quotient_graph(spark, sf_dir):
    labels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vertex"), F.col("n_regionkey").cast("long").alias("label"))
    return graph.quotient(net(spark, sf_dir), labels).groupBy("from_label", "to_label").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("flow"), 3).alias("flow"))


def bfs_rank(spark, sf_dir):
    edges = _strong(spark, sf_dir, 0.9)
    start = graph.vertices(edges).agg(F.min("vertex").alias("vertex"))
    return graph.hops(edges, start).select("vertex", F.col("rank").cast("long").alias("rank"), "before")


def topo_levels(spark, sf_dir):
    return graph.levels(_strong(spark, sf_dir, 0.8).filter("from_v < to_v")).select("vertex", F.col("level").cast("long").alias("level"))


def order_levels(spark, sf_dir):
    """How many orders come before each at least: an order waits for its customer's last one, a customer's first for the first of the customer before at its desk, every 50th; so does its third."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("to_v"), F.col("o_custkey").alias("customer"))
    own = Window.partitionBy("customer").orderBy("to_v")
    placed = orders.select("to_v", "customer", F.row_number().over(own).alias("nth"), F.lag("to_v").over(own).alias("last"))
    firsts = placed.filter("nth = 1").select("customer", F.lag("to_v").over(Window.partitionBy(F.col("customer") % 50).orderBy("customer")).alias("ahead"))
    waits = placed.join(firsts, "customer").select("to_v", F.explode(F.array("last", F.when(F.col("nth").isin(1, 3), F.col("ahead")))).alias("from_v"))
    return graph.levels(waits.withColumn("edge", F.col("to_v"))).select("vertex", F.col("level").cast("long").alias("level"))


def break_splittables(spark, sf_dir):
    edges = net(spark, sf_dir).filter("from_v <> to_v")
    least = _strong(spark, sf_dir, 0.95).select("edge", F.lit(True).alias("cut"))
    return graph.cut_apart(edges.join(least, "edge", "left").withColumn("cut", F.coalesce("cut", F.lit(False))), F.col("cut")).select("edge", "from_v", "to_v", "half")


def zeroflow_classify(spark, sf_dir):
    parts = components_threshold(spark, sf_dir)
    sources = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("vertex"), (F.abs("s_acctbal") > 1000).alias("flowing"))
    return parts.join(sources, "vertex").groupBy("component").agg(F.count_if("flowing").alias("n_flowing")).withColumn("is_flow", F.col("n_flowing") >= 2)


def descend_ascend_roundtrip(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("vertex"), F.col("c_mktsegment").alias("subgraph")).distinct().withColumn("local", F.col("vertex") % 10 * 10 + F.floor(F.col("vertex") / 10))
    measured = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("vertex")).agg(F.count(F.lit(1)).alias("n"))
    down = graph.descended(measured, members).select("subgraph", "local", "n")
    return graph.ascended(down, members).groupBy("vertex").agg(F.count(F.lit(1)).alias("n_subgraphs"), F.sum("n").alias("n_measured"))


def jumper_collapse(spark, sf_dir):
    jumpers = _strong(spark, sf_dir, 0.97).select(F.col("from_v").alias("u"), F.col("to_v").alias("v"))
    return graph.jumpers_collapsed(jumpers)


QUERIES = {
    f.__name__: f
    for f in (vertex_degree_ranked, source_sink_vertices, incidence_coo, reduced_incidence_split, orient_by_flow, components_threshold, quotient_graph, bfs_rank, topo_levels, order_levels, break_splittables, zeroflow_classify, descend_ascend_roundtrip, jumper_collapse)
}


def _components_sql() -> str:
    return f"""WITH RECURSIVE {strong_sql(0.97)},
v AS (SELECT from_v AS vertex FROM apart UNION SELECT to_v FROM apart),
reach AS (SELECT vertex, vertex AS root FROM v UNION SELECT b.v, reach.root FROM reach JOIN both_ways AS b ON b.u = reach.vertex),
parts AS (SELECT vertex, min(root) AS component FROM reach GROUP BY vertex)"""


ORACLES = {
    "vertex_degree_ranked": f"""
WITH {strong_sql(0.9)}, d AS (SELECT from_v AS vertex FROM e UNION ALL SELECT to_v FROM e)
SELECT vertex, count(*) AS degree FROM d GROUP BY vertex HAVING count(*) >= 5""",
    "source_sink_vertices": f"""
WITH {strong_sql(0.95)}, v AS (SELECT from_v AS vertex FROM e UNION SELECT to_v FROM e)
SELECT vertex, 'source' AS kind FROM v WHERE vertex NOT IN (SELECT to_v FROM e)
UNION ALL SELECT vertex, 'sink' FROM v WHERE vertex NOT IN (SELECT from_v FROM e)""",
    "incidence_coo": f"WITH {strong_sql(0.5)} SELECT from_v AS vertex, edge, -1 AS incidence FROM e UNION ALL SELECT to_v, edge, 1 FROM e",
    "reduced_incidence_split": f"""
WITH {strong_sql(0.5)}, c AS (SELECT from_v AS vertex, edge, -1 AS incidence FROM e UNION ALL SELECT to_v, edge, 1 FROM e)
SELECT edge, incidence, CASE WHEN vertex >= 20 THEN 'given' ELSE 'reduced' END AS part, CASE WHEN vertex >= 20 THEN vertex - 20 ELSE vertex END AS row FROM c""",
    "orient_by_flow": f"""
WITH {NET_SQL}, p AS (
  SELECT least(from_v, to_v) AS a, greatest(from_v, to_v) AS b, sum(CASE WHEN from_v < to_v THEN flow ELSE -flow END) AS flow FROM apart GROUP BY 1, 2)
SELECT CASE WHEN flow < 0 THEN b ELSE a END AS from_v, CASE WHEN flow < 0 THEN a ELSE b END AS to_v, round(abs(flow), 3) AS flow FROM p""",
    "components_threshold": f"{_components_sql()} SELECT vertex, component FROM parts",
    "quotient_graph": f"""
WITH {NET_SQL}
SELECT a.n_regionkey::BIGINT AS from_label, b.n_regionkey::BIGINT AS to_label, count(*) AS n_edges, round(sum(flow), 3) AS flow
FROM net JOIN nation a ON from_v = a.n_nationkey JOIN nation b ON to_v = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2""",
    "bfs_rank": f"""
WITH RECURSIVE {strong_sql(0.9)},
walk AS (SELECT min(u) AS vertex, 0 AS rank FROM both_ways UNION SELECT b.v, rank + 1 FROM walk JOIN both_ways b ON b.u = vertex WHERE rank < 25),
r AS (SELECT vertex, min(rank) AS rank FROM walk GROUP BY vertex)
SELECT r.vertex, r.rank::BIGINT AS rank, (SELECT min(q.vertex) FROM r q JOIN both_ways b ON b.u = q.vertex AND b.v = r.vertex WHERE q.rank = r.rank - 1) AS before FROM r""",
    "order_levels": """
WITH f AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_custkey) AS k FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey AS vertex, k + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 2 AS level FROM orders JOIN f USING (o_custkey)""",
    "topo_levels": f"""
WITH RECURSIVE {strong_sql(0.8)}, d AS (SELECT from_v, to_v FROM e WHERE from_v < to_v),
walk AS (SELECT v AS vertex, 0 AS level FROM (SELECT from_v AS v FROM d UNION SELECT to_v FROM d) UNION SELECT d.to_v, level + 1 FROM walk JOIN d ON d.from_v = vertex)
SELECT vertex, max(level)::BIGINT AS level FROM walk GROUP BY vertex""",
    "break_splittables": f"""
WITH {strong_sql(0.95)}
SELECT edge, from_v, to_v, 'whole' AS half FROM apart WHERE edge NOT IN (SELECT edge FROM e)
UNION ALL SELECT edge, from_v, NULL, 'sink' FROM e UNION ALL SELECT edge, NULL, to_v, 'source' FROM e""",
    "zeroflow_classify": f"""
{_components_sql()}
SELECT component, count(*) FILTER (abs(s_acctbal) > 1000) AS n_flowing, count(*) FILTER (abs(s_acctbal) > 1000) >= 2 AS is_flow
FROM parts JOIN supplier ON s_nationkey = vertex GROUP BY component""",
    "descend_ascend_roundtrip": """
WITH m AS (SELECT DISTINCT c_nationkey::BIGINT AS vertex, c_mktsegment FROM customer), s AS (SELECT s_nationkey AS vertex, count(*) AS n FROM supplier GROUP BY 1)
SELECT m.vertex, count(*) AS n_subgraphs, sum(n)::BIGINT AS n_measured FROM m JOIN s ON m.vertex = s.vertex GROUP BY m.vertex""",
    "jumper_collapse": f"""
WITH RECURSIVE {strong_sql(0.97)},
reach AS (SELECT u AS port, u AS root FROM both_ways UNION SELECT b.v, reach.root FROM reach JOIN both_ways b ON b.u = reach.port),
parts AS (SELECT port, min(root) AS root FROM reach GROUP BY port)
SELECT port, dense_rank() OVER (ORDER BY root) - 1 AS vertex FROM parts""",
}
