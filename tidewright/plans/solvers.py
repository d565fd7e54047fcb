"""Sequential and non-linear solvers over the test tables; where a closed form exists, SQL has it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.operators import advection, blocks, graph, hydraulics
from tidewright.plans.tables import BLOCKS_SQL, NET_SQL, net, strong, strong_sql, table


def batch_advection(spark, sf_dir):
    """Each user's readings as what enters a pipe of 1 to 3 kilometres, 40 seconds a step."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    inlets = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pipe"), (F.row_number().over(order) - 1).alias("step"), (F.lit(0.5) + F.pmod("value", F.lit(100.0)) / 200).alias("flow"), (F.col("value") + 800).alias("value"), (F.col("event_type") != "error").alias("confident")
    )
    pipes = inlets.select("pipe").distinct().select("pipe", (1000.0 + F.pmod(F.col("pipe"), F.lit(10)) * 200).alias("length"), F.lit(0.7).alias("diameter"))
    return advection.advected(inlets, pipes, 40.0, 860.0)


def nodal_pressures(spark, sf_dir):
    """A ladder of resistances for each supplier: what it has on account flows in, and the last vertex has a given pressure."""
    rungs = 4
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 10_000 + 0.1).alias("q"))
    none = F.lit(None)

    def edge(i, a, b, kind, resistance, pressure, flow):
        params = F.create_map(F.lit("resistance"), F.lit(float(resistance))) if resistance else F.create_map(F.lit("resistance"), F.lit(1.0))
        cast = lambda v, t: (none if v is None else v if not isinstance(v, int | float) else F.lit(v)).cast(t)
        return F.struct(F.lit(i).alias("edge"), cast(a, "long").alias("from_v"), cast(b, "long").alias("to_v"), F.lit(kind).alias("kind"), params.alias("params"), cast(pressure, "double").alias("pressure"), cast(flow, "double").alias("flow"))

    listed = [edge(0, None, 0, "source", 0, None, F.col("q")), edge(1, rungs, None, "sink", 0, 1e5, None)]
    for i in range(rungs):
        listed += [edge(2 + 2 * i, i, i + 1, "resistance", 300 + 100 * i, None, None), edge(3 + 2 * i, i, i + 1, "resistance", 500, None, None)]
    return hydraulics.nodal_pressures(rows.select("s_suppkey", F.inline(F.array(*listed))), ["s_suppkey"]).withColumn("pressure", F.round("pressure", 3))


#: Head curves of the two pumps of pump_station, in metres over m3/h, and the resistance behind them.
HEADS, PIPE_RESISTANCE = ((240.0, -0.02), (180.0, -0.015)), 4.0e5


def pump_station(spark, sf_dir):
    """For each supplier, two pumps in series lift from a given pressure through a resistance to one that is 2 MPa higher; a closed gate shuts off a side branch."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.abs("s_acctbal") * 50 + 1e5).alias("p"))
    number = lambda v: v if not isinstance(v, int | float) else F.lit(float(v))
    params = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), number(v))])

    def edge(i, a, b, kind, given=None, pressure=None, flow=None):
        end = lambda v: F.lit(v).cast("long")
        maybe = lambda v: (F.lit(None) if v is None else number(v)).cast("double")
        return F.struct(F.lit(i).alias("edge"), end(a).alias("from_v"), end(b).alias("to_v"), F.lit(kind).alias("kind"), (given if given is not None else params(none=0)).alias("params"), maybe(pressure).alias("pressure"), maybe(flow).alias("flow"))

    pump = lambda i: params(head_0=HEADS[i][0], head_1=HEADS[i][1], density=850)
    listed = [
        edge(0, None, 0, "source", pressure=F.col("p")),
        edge(1, 0, 1, "pump", pump(0)),
        edge(2, 1, 2, "pump", pump(1)),
        edge(3, 2, 3, "resistance", params(resistance=PIPE_RESISTANCE)),
        edge(4, 3, None, "sink", pressure=F.col("p") + 2e6),
        edge(5, 2, 4, "valve", params(opening=0, xi=2, diameter=0.3)),
        edge(6, 4, None, "sink", flow=0),
    ]
    found = hydraulics.nodal_pressures(rows.select("s_suppkey", F.inline(F.array(*listed))), ["s_suppkey"])
    return found.select("s_suppkey", "vertex", F.round("pressure", 1).alias("pressure"), "converged")


def biconnected_blocks(spark, sf_dir):
    return blocks.blocks(strong(net(spark, sf_dir), 0.93))


def block_cut_vertices(spark, sf_dir):
    return blocks.cut_vertices(blocks.blocks(strong(net(spark, sf_dir), 0.97)))


def boundary_edges(spark, sf_dir):
    """Edges that leave or enter the nations of region 0."""
    inside = table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("vertex"))
    return graph.boundary(net(spark, sf_dir), inside).select("edge", "inside_v", F.round("flow", 3).alias("flow"))


def induced_subgraph(spark, sf_dir):
    inside = table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("vertex"))
    return graph.induced(net(spark, sf_dir), inside).withColumn("flow", F.round("flow", 3))


QUERIES = {f.__name__: f for f in (batch_advection, nodal_pressures, pump_station, biconnected_blocks, block_cut_vertices, boundary_edges, induced_subgraph)}


ORACLES = {
    "nodal_pressures": """
WITH s AS (SELECT s_suppkey, abs(s_acctbal) / 10000 + 0.1 AS q FROM supplier),
r(i, g) AS (SELECT i, 1 / sqrt((300 + 100 * i)::DOUBLE) + 1 / sqrt(500::DOUBLE) FROM range(4) AS t(i)),
v(vertex) AS (SELECT i FROM range(5) AS t(i))
SELECT s_suppkey, vertex, round(1e5 + coalesce(sum(pow(q / g, 2)), 0), 3) AS pressure, true AS converged
FROM s CROSS JOIN v LEFT JOIN r ON r.i >= vertex GROUP BY s_suppkey, vertex""",
    "pump_station": f"""
WITH s AS (SELECT s_suppkey, abs(s_acctbal) * 50 + 1e5 AS p FROM supplier),
k AS (SELECT *, 850 * 9.81::DOUBLE AS w, {HEADS[0][0]}::DOUBLE AS a1, {-HEADS[0][1]}::DOUBLE AS b1, {HEADS[1][0]}::DOUBLE AS a2, {-HEADS[1][1]}::DOUBLE AS b2, {PIPE_RESISTANCE}::DOUBLE AS r FROM s),
f AS (SELECT *, (-w * (b1 + b2) * 3600 + sqrt(pow(w * (b1 + b2) * 3600, 2) + 4 * r * (w * (a1 + a2) - 2e6))) / (2 * r) AS q FROM k)
SELECT s_suppkey, vertex, round(CASE vertex WHEN 0 THEN p WHEN 1 THEN p + w * (a1 - b1 * 3600 * q) WHEN 2 THEN p + w * (a1 - b1 * 3600 * q) + w * (a2 - b2 * 3600 * q) WHEN 3 THEN p + 2e6 END, 1) AS pressure, true AS converged
FROM f, (SELECT i AS vertex FROM range(5) AS t(i))""",
    "biconnected_blocks": f"""
WITH RECURSIVE {strong_sql(0.93)}, {BLOCKS_SQL} SELECT e.edge, from_v, to_v, block, is_bridge FROM blocks JOIN e ON e.edge = blocks.edge""",
    "block_cut_vertices": f"""
WITH RECURSIVE {strong_sql(0.97)}, v AS (SELECT DISTINCT u AS vertex FROM both_ways),
walk AS (SELECT x.vertex AS without, y.vertex AS a, y.vertex AS b FROM v x, v y WHERE x.vertex <> y.vertex
         UNION SELECT without, a, v FROM walk JOIN both_ways ON u = b WHERE v <> without),
part AS (SELECT without, a, min(b) AS part FROM walk GROUP BY without, a)
SELECT without AS vertex, count(DISTINCT part) AS n_blocks FROM part JOIN both_ways ON u = without AND v = a GROUP BY without HAVING count(DISTINCT part) > 1""",
    "boundary_edges": f"""
WITH {NET_SQL}, i AS (SELECT n_nationkey AS v FROM nation WHERE n_regionkey = 0)
SELECT edge, CASE WHEN from_v IN (SELECT v FROM i) THEN from_v ELSE to_v END AS inside_v, round(flow, 3) AS flow
FROM net WHERE (from_v IN (SELECT v FROM i)) <> (to_v IN (SELECT v FROM i))""",
    "induced_subgraph": f"""
WITH {NET_SQL}, i AS (SELECT n_nationkey AS v FROM nation WHERE n_regionkey = 0)
SELECT edge, from_v, to_v, round(flow, 3) AS flow FROM net WHERE from_v IN (SELECT v FROM i) AND to_v IN (SELECT v FROM i)""",
}
