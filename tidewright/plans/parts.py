"""Blocks of the network of nations, profiles of parts as pipes, and what is said of parts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions import heat, profiles
from tidewright.operators import bindings, blocks, flows
from tidewright.plans.tables import BLOCKS_SQL, net, strong, strong_sql, table


def _turned(spark, sf_dir):
    """Edges from the nation of the smaller number to the other, and their blocks."""
    edges = strong(net(spark, sf_dir), 0.93)
    low, high = F.least("from_v", "to_v"), F.greatest("from_v", "to_v")
    return blocks.blocks(edges.withColumns({"from_v": low, "to_v": high})), edges


def edge_blocks(spark, sf_dir):
    return bindings.block_of_edges(_turned(spark, sf_dir)[0])


def block_vertex_levels(spark, sf_dir):
    """Within each block, the most edges from where it begins to each of its nations."""
    return bindings.levels_within(_turned(spark, sf_dir)[0])


def block_balance(spark, sf_dir):
    """What other blocks bring to each block, less what they take."""
    blocked, edges = _turned(spark, sf_dir)
    return bindings.block_imbalance(blocked, edges).withColumn("imbalance", F.round("imbalance", 3))


def problems_put_together(spark, sf_dir):
    """Suppliers and customers in debt as diagnostics of two parts of a network with different columns."""
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.lit("supplier").alias("part"), F.col("s_nationkey").cast("long").alias("vertex"), F.round("s_acctbal", 2).alias("lacks"))
    customers = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.lit("customer").alias("part"), F.col("c_nationkey").cast("long").alias("vertex"), F.col("c_mktsegment").alias("segment"))
    return bindings.put_together([suppliers, customers]).groupBy("part", "vertex", "segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lacks"), 2).alias("lacks"))


def flowing_region(spark, sf_dir):
    """The one region that holds the nation with most suppliers."""
    counted = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    regions = table(spark, sf_dir, "nation").join(counted, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").cast("long").alias("subgraph")).agg(F.sum("n").alias("n_suppliers"), F.max(F.struct("n", -F.col("n_nationkey"))).alias("most"))
    best = Window.orderBy(F.col("most").desc())
    return bindings.single_flow_part(regions.withColumn("is_flow", F.row_number().over(best) == 1)).select("subgraph", "n_suppliers", "is_flow")


def unsure_readings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "purchase").alias("confident"))
    return bindings.unsure(rows)


def flows_at_rest(spark, sf_dir):
    """Lines that were taken without a discount or a tax, by order."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(flows.is_at_rest(F.col("l_discount") * F.col("l_tax"))).alias("n_resting"))


def _points(spark, sf_dir):
    """Parts of a size are the points of a pipe, in order of their keys."""
    return table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("pipe"), F.col("p_partkey").cast("double").alias("x"), F.round("p_retailprice", 2).alias("height"))


def subdivided_profiles(spark, sf_dir):
    return profiles.subdivided(_points(spark, sf_dir), 20.0, ["height"]).select("pipe", F.round("x", 6).alias("x"), F.round("height", 7).alias("height"))


def decimated_profiles(spark, sf_dir):
    """The first part of a size from each supplier's key on."""
    samples = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50 + 1).cast("long").alias("pipe"), (F.col("s_suppkey") * 7.5).alias("sample"))
    return profiles.decimated(_points(spark, sf_dir), samples)


def uniform_profiles(spark, sf_dir):
    """Points 30 apart on steps of 60 or a little more: the highest of those nearest to each."""
    place = F.row_number().over(Window.partitionBy("pipe").orderBy("x")) - 1
    even = _points(spark, sf_dir).select("pipe", (place * 30.0).alias("x"), "height", (10_000 - F.col("height")).alias("capacity"))
    return profiles.uniform(even, 30.0).select("pipe", "point", F.round("x", 4).alias("x"), "height", F.round("capacity", 2).alias("capacity"))


#: What suppliers' pipes are like: kg/s, kg/m3, J/(kg K), m, m, W/(m2 K), K; and points of a profile and metres between them.
MASS, DENSITY, CAPACITY, DIAMETER, ROUGHNESS, TRANSFER, GROUND = 120.0, 850.0, 2000.0, 0.5, 1e-4, 3.0, 280.0
POINTS, APART = 6, 1500.0


def shukhov_profiles(spark, sf_dir):
    """How suppliers' flows cool to what surrounds them, friction included."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (290 + F.abs("s_acctbal") / 500).alias("start"))
    found = heat.shukhov_profile(F.lit(POINTS), APART, start="start", ambient=GROUND, mass_flow=MASS, density=DENSITY, capacity=CAPACITY, diameter=DIAMETER, roughness=ROUGHNESS, heat_transfer=TRANSFER)
    return rows.select("s_suppkey", F.posexplode(found).alias("point", "t")).select("s_suppkey", F.col("point").cast("long").alias("point"), F.round("t", 6).alias("temperature"))


QUERIES = {
    f.__name__: f
    for f in (edge_blocks, block_vertex_levels, block_balance, problems_put_together, flowing_region, unsure_readings, flows_at_rest, subdivided_profiles, decimated_profiles, uniform_profiles, shukhov_profiles)
}

_BLOCKED = f"WITH RECURSIVE {strong_sql(0.93)}, {BLOCKS_SQL}"

ORACLES = {
    "edge_blocks": f"{_BLOCKED} SELECT edge, block FROM blocks",
    "block_vertex_levels": f"""{_BLOCKED},
t AS (SELECT block, least(from_v, to_v) AS a, greatest(from_v, to_v) AS b FROM e JOIN blocks USING (edge)),
paths AS (SELECT DISTINCT block, a AS vertex, 0 AS level FROM t UNION SELECT DISTINCT block, b, 0 FROM t UNION SELECT paths.block, b, level + 1 FROM paths JOIN t ON t.block = paths.block AND a = vertex)
SELECT block, vertex, max(level)::BIGINT AS level FROM paths GROUP BY block, vertex""",
    "block_balance": f"""{_BLOCKED},
x AS (SELECT e.edge, block, from_v, to_v, flow FROM e JOIN blocks ON blocks.edge = e.edge),
s AS (SELECT block AS own, from_v AS vertex, -flow AS signed FROM x UNION ALL SELECT block, to_v, flow FROM x),
i AS (SELECT DISTINCT block, unnest([from_v, to_v]) AS vertex FROM x)
SELECT block, round(sum(signed), 3) AS imbalance FROM i JOIN s ON s.vertex = i.vertex AND own <> block GROUP BY block""",
    "problems_put_together": """
SELECT 'supplier' AS part, s_nationkey::BIGINT AS vertex, NULL::VARCHAR AS segment, count(*) AS n, round(sum(round(s_acctbal, 2)), 2) AS lacks FROM supplier WHERE s_acctbal < 0 GROUP BY s_nationkey
UNION ALL SELECT 'customer', c_nationkey, c_mktsegment, count(*), NULL FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey, c_mktsegment""",
    "flowing_region": """
WITH c AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), best AS (SELECT k FROM c ORDER BY n DESC, k LIMIT 1)
SELECT n_regionkey::BIGINT AS subgraph, sum(n)::BIGINT AS n_suppliers, true AS is_flow FROM nation JOIN c ON k = n_nationkey WHERE n_regionkey = (SELECT n_regionkey FROM nation JOIN best ON k = n_nationkey) GROUP BY n_regionkey""",
    "unsure_readings": "SELECT event_id, false AS confident FROM events",
    "flows_at_rest": "SELECT l_orderkey, count(*) FILTER (abs(l_discount * l_tax) <= 1e-12) AS n_resting FROM lineitem GROUP BY 1",
    "subdivided_profiles": """
WITH p AS (SELECT p_size::BIGINT AS pipe, p_partkey::DOUBLE AS x, round(p_retailprice, 2) AS h, lead(p_partkey::DOUBLE) OVER w AS nx, lead(round(p_retailprice, 2)) OVER w AS nh FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey)),
n AS (SELECT *, coalesce(greatest(1, ceil((nx - x) / 20 - 1e-8::DOUBLE)), 1)::INTEGER AS n FROM p)
SELECT pipe, round(x + coalesce(nx - x, 0) * i / n, 6) AS x, round(h + coalesce(nh - h, 0) * i / n, 7) AS height FROM n, unnest(range(n)) AS t(i)""",
    "decimated_profiles": """
WITH s AS (SELECT s_suppkey % 50 + 1 AS pipe, s_suppkey * 7.5::DOUBLE AS sample FROM supplier)
SELECT pipe, sample, (SELECT min(p_partkey::DOUBLE) FROM part WHERE p_size = pipe AND p_partkey + 1e-8::DOUBLE >= sample) AS x FROM s""",
    "uniform_profiles": """
SELECT p_size::BIGINT AS pipe, row_number() OVER w - 1 AS point, (row_number() OVER w - 1) * 30.0::DOUBLE AS x, round(p_retailprice, 2) AS height, round(10000 - round(p_retailprice, 2), 2) AS capacity
FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey) QUALIFY count(*) OVER (PARTITION BY p_size) > 1""",
    "shukhov_profiles": f"""
WITH k AS (SELECT 4 * {MASS}::DOUBLE / ({math.pi}::DOUBLE * {DIAMETER}::DOUBLE * {DIAMETER}::DOUBLE * {DENSITY}::DOUBLE) AS v, 0.11::DOUBLE * pow({ROUGHNESS}::DOUBLE, 0.25) AS lam),
t AS (SELECT {GROUND}::DOUBLE + lam * {DENSITY}::DOUBLE * pow(v, 3) / (8 * {TRANSFER}::DOUBLE) AS tends, {math.pi}::DOUBLE * {DIAMETER}::DOUBLE * {TRANSFER}::DOUBLE / ({CAPACITY}::DOUBLE * {MASS}::DOUBLE) AS rate FROM k)
SELECT s_suppkey, i AS point, round(tends + (290 + abs(s_acctbal) / 500 - tends) * exp(-rate * i * {APART}::DOUBLE), 6) AS temperature FROM supplier, t, range({POINTS}) AS r(i)""",
}
