"""Kernels on the test tables beside closed forms: faces of finite volumes, head curves, searches, pipes, parts without flow, cycles, balances of parts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions import profiles
from tidewright.operators import advection, blocks, compare, flows, forest, hydraulics, identify, mixing, pipe_tasks, thermal, transport, zeroflow
from tidewright.operators.transport import Edge
from tidewright.plans.networks import _daily
from tidewright.plans.pipes import _ISAEV
from tidewright.plans.tables import BLOCKS_SQL, net, strong, strong_sql, table

COURANT = 0.4


def face_schemes(spark, sf_dir):
    """One step of each scheme over a user's readings as cells, at a Courant number of 0.4; what comes in equals the first cell."""
    order = Window.partitionBy("user_id").orderBy("ts")
    cells = table(spark, sf_dir, "events").select(F.col("user_id").alias("pipe"), F.row_number().over(order).cast("long").alias("nth"), (F.col("value") + 800).alias("value"))

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        now = rows["value"].to_numpy()
        schemes = {"upstream": advection.upstream_faces, "quick": advection.quick_faces, "quickest": advection.quickest_faces, "ultimate": advection.ultimate_faces}
        moved = {n: advection.fv_step(now, now[0], now[-1], COURANT, 1.0, 1.0, f) for n, f in schemes.items()}
        return rows[["pipe", "nth"]].assign(**moved, characteristics=advection.moc_step(now, now[0], COURANT, 1.0, 1.0))

    kinds = ("upstream", "quick", "quickest", "ultimate", "characteristics")
    moved = cells.groupBy("pipe").applyInPandas(step, "pipe long, nth long, " + ", ".join(f"{k} double" for k in kinds))
    return moved.select("pipe", "nth", *[F.round(k, 6).alias(k) for k in kinds])


#: A head curve without a cubic part, in metres over m3/h, and the flow up to which it holds.
HEAD, MOST_FLOW = (260.0, -0.01, -3.0e-6), 6000.0


def head_curves(spark, sf_dir):
    """The flow at which a pump has a head, on its curve, and on the straight lines that go on from it at both ends."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 12 - 300).alias("head"))

    def inverse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        curve = profiles.head_curve([*HEAD, 0.0], 0.0, MOST_FLOW)
        for part in parts:
            found = {h: profiles.flow_at(curve, h) for h in part["head"].unique()}
            yield part.assign(flow=part["head"].map(found), back=[profiles.head_at(curve, found[h]) for h in part["head"]])[["l_orderkey", "l_linenumber", "flow", "back"]]

    return rows.mapInPandas(inverse, "l_orderkey long, l_linenumber int, flow double, back double").select("l_orderkey", "l_linenumber", F.round("flow", 4).alias("flow"), F.round("back", 4).alias("back"))


def searches(spark, sf_dir):
    """For each supplier: where a valley is least, how far a step is halved, a root within a bracket, real roots of a cubic."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 20_000 + 0.2).alias("a"))

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            a = part["a"].to_numpy()
            yield part[["s_suppkey"]].assign(
                valley=[identify.golden_section(lambda x, t=t: (x - t) ** 2) for t in a],
                halved=[identify.halving(lambda x, t=t: (x - t) ** 2, 4.0) for t in a],
                root=[hydraulics.bracketed_root(lambda x, t=t: x**3 - t, 0.0, 2.0) for t in a],
                largest=[max(profiles.cubic_roots(1.0, -t, 0.0, 0.0)) for t in a],
                stepped=[float(pipe_tasks.trimmed_step(np.array([t]), np.array([5 * t]), np.array([0.0]), np.array([1.5]), np.array([1.0]))[0]) for t in a],
            )

    kinds = ("valley", "halved", "root", "largest", "stepped")
    found = rows.mapInPandas(search, "s_suppkey long, " + ", ".join(f"{k} double" for k in kinds))
    off = lambda k: (F.round(F.col(k) - F.col("a"), 4) + 0.0).alias(k)
    return found.join(rows, "s_suppkey").select("s_suppkey", off("valley"), "halved", F.round("root", 5).alias("root"), off("largest"), F.round("stepped", 5).alias("stepped"))


def pipe_histories(spark, sf_dir):
    """Outlet pressures of parts as pipes at a flow for each size, with properties that don't change along them."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pipe"), (F.col("p_size") * 100.0 + 400).alias("length"), F.lit(0.5).alias("diameter"), F.lit(1.0e-4).alias("roughness"), (F.col("p_size") * 0.5).alias("rise"))
    history = parts.select("pipe", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step"), "length").select(
        "pipe", "step", (F.lit(0.05) + F.col("step") * 0.1).alias("flow"), F.lit(5e6).alias("p_in"), F.lit(None).cast("double").alias("p_out"), F.lit(860.0).alias("density"), F.lit(1.2e-5).alias("viscosity")
    )
    return pipe_tasks.quasistatic(history, parts, 60.0).select("pipe", "step", F.round("p_out", 2).alias("p_out"))


#: What suppliers' pipes carry at a Courant number of 1: metres, m3/s, heat transfer and cells.
THERMAL_LENGTH, THERMAL_FLOW, TRANSFER, THERMAL_CELLS = 2000.0, 0.2, 3.0, 10


def thermal_histories(spark, sf_dir):
    """Outlet temperatures of suppliers' pipes, each with its own inlet temperature, until the pipe is replaced and after."""
    inlet = 290 + F.abs("s_acctbal") / 500
    velocity = THERMAL_FLOW / (math.pi * 0.25 / 4)
    history = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("pipe"), F.explode(F.sequence(F.lit(0), F.lit(14))).alias("step"), F.lit(THERMAL_FLOW).alias("flow"), F.lit(5e6).alias("p_in"), inlet.alias("temperature"), F.lit(850.0).alias("density"), F.lit(1e-5).alias("viscosity"), F.lit(0.0).alias("fall"), F.lit(280.0).alias("ambient")
    )
    pipes = history.select("pipe").distinct().select("pipe", F.lit(THERMAL_LENGTH).alias("length"), F.lit(0.5).alias("diameter"), F.lit(1e-4).alias("roughness"), F.lit(TRANSFER).alias("transfer"))
    found = thermal.quasistatic(history, pipes, thermal.fastest_step(THERMAL_LENGTH / THERMAL_CELLS, velocity))
    return found.select("pipe", "step", F.round("t_out", 6).alias("t_out"), F.round("p_out", 2).alias("p_out"))


def euler_steps(spark, sf_dir):
    """y' = -0.1 y from the first reading of each user in steps of 1, plain and corrected."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", "ts").alias("start"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            both = [(hydraulics.euler_profile(lambda i, y: -0.1 * y, s, [1.0] * 8)[-1], hydraulics.euler_profile(lambda i, y: -0.1 * y, s, [1.0] * 8, corrected=True)[-1]) for s in part["start"]]
            yield part[["user_id"]].assign(plain=[a for a, _ in both], corrected=[b for _, b in both])

    return rows.mapInPandas(run, "user_id long, plain double, corrected double").select("user_id", F.round("plain", 6).alias("plain"), F.round("corrected", 6).alias("corrected"))


def redundant_parts(spark, sf_dir):
    """Whether each nation has as many suppliers in credit, as meters, as it has customers' segments, as ends."""
    meters = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("part")).agg((F.count(F.lit(1)) + 5).alias("n_meters"))
    ends = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("part")).agg(F.countDistinct("c_mktsegment").alias("n_ends"))
    return flows.redundant_parts(meters.join(ends, "part"))


def cuts_turned(spark, sf_dir):
    cuts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linestatus") == "O").alias("is_sink"), (F.col("l_extendedprice") - 30_000).alias("flow"))
    return blocks.turned_by_flow(cuts).withColumn("flow", F.round("flow", 2))


def _links(spark, sf_dir, share):
    return strong(net(spark, sf_dir), share).select("edge", F.col("from_v").alias("u"), F.col("to_v").alias("v"))


def cycle_count(spark, sf_dir):
    """Independent cycles of the network of nations, and whether each is one way round: two of its edges at each of its vertices."""
    edges = _links(spark, sf_dir, 0.8)
    cycles = forest.fundamental_cycles(edges)
    ends = cycles.join(edges, "edge").select("cycle", F.explode(F.array("u", "v")).alias("vertex")).groupBy("cycle", "vertex").agg(F.count(F.lit(1)).alias("n"))
    return ends.groupBy("cycle").agg(F.bool_and(F.col("n") == 2).alias("is_simple")).agg(F.count(F.lit(1)).alias("n_cycles"), F.coalesce(F.bool_and("is_simple"), F.lit(True)).alias("are_simple"))


def nested_cycles(spark, sf_dir):
    """Edges of cycles that share edges, directly or through others."""
    return forest.nested_cycles(forest.fundamental_cycles(_links(spark, sf_dir, 0.93)))


def _gated(spark, sf_dir):
    """The network of nations cut at every third edge; one-sided edges of nations with suppliers, those whose suppliers owe much at rest."""
    two = strong(net(spark, sf_dir), 0.95).select("edge", "from_v", "to_v", (F.col("edge") % 3 == 0).alias("is_closed"), F.lit(False).alias("is_resting"))
    inside = two.select(F.explode(F.array("from_v", "to_v")).alias("v")).distinct()
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("v")).agg(F.max("s_acctbal").alias("most"))
    one = suppliers.join(inside, "v").select((F.lit(10_000) + F.col("v")).alias("edge"), F.lit(None).cast("long").alias("from_v"), F.col("v").alias("to_v"), F.lit(False).alias("is_closed"), (F.col("most") < 9000).alias("is_resting"))
    return two.unionByName(one)


def zero_flow_split(spark, sf_dir):
    """Which nations are in parts that flow reaches."""
    at = zeroflow.part_vertices(zeroflow.split(_gated(spark, sf_dir)))
    return at.groupBy("vertex").agg(F.bool_or("is_flow").alias("carries_flow"))


def zero_flow_edges(spark, sf_dir):
    """Which edges, and halves of closed ones, rest, and which are in parts that carry flow."""
    return zeroflow.split(_gated(spark, sf_dir)).select("edge", "half", "is_zero", "is_flow")


def zero_flow_members(spark, sf_dir):
    """How many vertices and edges the subgraphs have, and that going down to local numbers and up again changes nothing."""
    parts = zeroflow.split(_gated(spark, sf_dir))
    vertices, edges = zeroflow.members(parts)
    up = vertices.select(F.col("subgraph").alias("s"), F.col("local").alias("to_local"), F.col("vertex").alias("to_v"))
    back = edges.filter("to_local is not null").join(up, (F.col("subgraph") == F.col("s")) & (edges.to_local == up.to_local)).select("edge", "half", "to_v")
    same = parts.select("edge", "half", "to_v").filter("to_v is not null").intersect(back).agg(F.count(F.lit(1)).alias("n_same"))
    sizes = vertices.agg(F.countDistinct("subgraph").alias("n_subgraphs"), F.count(F.lit(1)).alias("n_places"))
    return sizes.crossJoin(same)  # one row each


#: A triangle of gates fed at two corners, a side outlet at the third and a pair of pipes behind.
LOOPED = [
    Edge("s1", "source", None, 0), Edge("s2", "source", None, 1), Edge("a", "lumped", 0, 1), Edge("b", "lumped", 1, 2), Edge("c", "lumped", 0, 2),
    Edge("s3", "source", 2, None), Edge("link", "lumped", 1, 3), Edge("p1", "pipe", 3, 4, 800.0, 0.5), Edge("p2", "pipe", 3, 4, 800.0, 0.5), Edge("end", "source", 4, None),
]


def loop_transport(spark, sf_dir):
    """Density behind a loop each day; days on which more is drawn than comes in turn the flow behind it."""
    meters = _daily(spark, sf_dir).select(F.datediff("t", F.lit("1990-01-01").cast("date")).cast("long").alias("step"), F.col("edge").alias("name"), F.col("value").alias("flow")).withColumn("flow", F.when(F.col("name") == "s3", F.col("flow") / 1000).otherwise(F.col("flow")))
    whole = meters.join(meters.groupBy("step").count().filter("count = 3").select("step"), "step")
    entering = spark.createDataFrame([("s1", 800.0), ("s2", 900.0)], "name string, nominal double")
    rows, _, _ = transport.metered_transport(LOOPED, whole, entering)
    return rows.filter("name in ('s3', 'p1', 'b')").select("step", "name", F.round("outlet", 6).alias("density"))


def confident_places(spark, sf_dir):
    """Steps at which users' readings are confident, and users that have any."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("place"), F.col("event_id").alias("step"), F.when(F.col("event_type") == "purchase", compare.CONFIDENT).otherwise("unused").alias("status"))
    steps = compare.confident_steps(rows).select("place", F.size("steps").cast("long").alias("n"), F.element_at("steps", 1).alias("first"))
    return compare.with_any_confidence(rows).groupBy("place").agg(F.count(F.lit(1)).alias("n_all")).join(steps, "place")


def viscosity_and_trust(spark, sf_dir):
    """Mixtures whose weights sum to almost nothing, whose weights are zero, and of one inlet."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("vertex"), F.when(F.col("l_orderkey") % 3 == 0, 0.0).when(F.col("l_orderkey") % 3 == 1, F.col("l_quantity") * 1e-12).otherwise(F.col("l_quantity")).alias("flow"), (F.col("l_tax") * 1.2345679 + 0.7).alias("density")
    )
    return mixing.mixed(rows).withColumn("density", F.round("density", 6))


def friction_identified(spark, sf_dir):
    """The friction factor that the outlet pressures of suppliers, as pipes, were made with."""
    parts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("pipe"), (F.abs("s_acctbal") / 10 + 400).alias("length"), F.lit(0.5).alias("diameter"))
    history = parts.select("pipe", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("step")).select("pipe", "step", (F.lit(0.1) + F.col("step") * 0.05).alias("flow"), F.lit(5e6).alias("p_in"), F.lit(None).cast("double").alias("p_out"), F.lit(860.0).alias("density"), F.lit(1.2e-5).alias("viscosity"))
    made = pipe_tasks.quasistatic(history, parts.withColumn("friction_factor", F.lit(1.3)), 60.0)
    seen = history.drop("p_out").join(made.select("pipe", "step", "p_out"), ["pipe", "step"])
    factor, _, outcome = pipe_tasks.identified(seen, parts, 60.0, "friction_factor")
    return spark.createDataFrame([(round(factor, 4), outcome)], "factor double, outcome string")


QUERIES = {
    f.__name__: f
    for f in (face_schemes, head_curves, searches, pipe_histories, thermal_histories, euler_steps, redundant_parts, cuts_turned, cycle_count, nested_cycles, zero_flow_split, zero_flow_edges, zero_flow_members, loop_transport, confident_places, viscosity_and_trust, friction_identified)
}

_C = f"{COURANT}::DOUBLE"
_W = "a AS (SELECT edge, from_v, to_v FROM e)"

#: After strong_sql(0.95): the cut network; what rests is told by walking from both ends of each edge without it.
GATED_SQL = f"""{strong_sql(0.95)},
cut AS (SELECT edge, h AS half, CASE h WHEN 'source' THEN NULL ELSE from_v END AS from_v, CASE h WHEN 'sink' THEN NULL ELSE to_v END AS to_v, edge % 3 = 0 AS rests
    FROM e, unnest(CASE WHEN edge % 3 = 0 THEN ['sink', 'source'] ELSE ['whole'] END) AS t(h)
  UNION ALL SELECT 10000 + s_nationkey, 'whole', NULL, s_nationkey, max(s_acctbal) < 9000 FROM supplier WHERE s_nationkey IN (SELECT u FROM both_ways) GROUP BY s_nationkey),
two AS (SELECT * FROM cut WHERE NOT rests AND from_v IS NOT NULL AND to_v IS NOT NULL),
ways AS (SELECT edge, from_v AS a, to_v AS b FROM two UNION ALL SELECT edge, to_v, from_v FROM two),
starts AS (SELECT edge AS without, from_v AS start FROM two UNION ALL SELECT edge, to_v FROM two UNION ALL SELECT -edge, to_v FROM cut WHERE edge >= 10000),
walk AS (SELECT without, start, start AS here FROM starts UNION SELECT without, start, b FROM walk JOIN ways ON a = here AND edge <> without),
sides AS (SELECT without, start, count(*) AS n_v, (SELECT count(*) FROM two WHERE edge <> w.without AND from_v IN (SELECT here FROM walk AS x WHERE x.without = w.without AND x.start = w.start)) AS n_e,
    (SELECT count(*) FROM cut WHERE NOT rests AND from_v IS NULL AND edge <> -w.without AND to_v IN (SELECT here FROM walk AS x WHERE x.without = w.without AND x.start = w.start)) AS n_s FROM walk AS w GROUP BY without, start),
dead AS (SELECT abs(without) AS edge FROM sides WHERE n_s = 0 AND n_e = n_v - 1),
bridges AS (SELECT edge FROM two WHERE NOT EXISTS (SELECT 1 FROM walk WHERE without = edge AND start = from_v AND here = to_v)),
zero AS (SELECT edge FROM dead WHERE edge >= 10000 OR edge IN (SELECT edge FROM bridges)),
marked AS (SELECT cut.*, rests OR edge IN (SELECT edge FROM zero) AS is_zero FROM cut),
joined AS (SELECT is_zero, from_v AS a, to_v AS b FROM marked WHERE from_v IS NOT NULL AND to_v IS NOT NULL UNION SELECT is_zero, to_v, from_v FROM marked WHERE from_v IS NOT NULL AND to_v IS NOT NULL),
near AS (SELECT is_zero, v, v AS other FROM marked, unnest([from_v, to_v]) AS t(v) WHERE v IS NOT NULL UNION SELECT near.is_zero, v, b FROM near JOIN joined ON joined.is_zero = near.is_zero AND a = other),
named AS (SELECT is_zero, v, min(other) AS part FROM near GROUP BY is_zero, v),
inside AS (SELECT marked.*, part FROM marked JOIN named ON named.is_zero = marked.is_zero AND v = coalesce(from_v, to_v)),
placed AS (SELECT *, NOT is_zero AND count(*) FILTER (from_v IS NULL OR to_v IS NULL) OVER (PARTITION BY is_zero, part) >= 2 AS is_flow FROM inside)"""

ORACLES = {
    "face_schemes": f"""
WITH n AS (SELECT user_id AS pipe, row_number() OVER w AS nth, count(*) OVER (PARTITION BY user_id) AS n, value + 800 AS c, lag(value + 800) OVER w AS l, lead(value + 800) OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
f AS (SELECT *, nth = 1 OR nth = n AS at_end, (c + r) / 2 - (l + r - 2 * c) / 8 AS quick, (c + r) / 2 - {_C} * (r - c) / 2 - (1 - {_C} * {_C}) / 6 * (l + r - 2 * c) AS quickest, l + (c - l) / {_C} AS ref FROM n),
u AS (SELECT *, CASE WHEN abs(l + r - 2 * c) >= abs(r - l) THEN c WHEN r > l THEN least(greatest(quickest, c), greatest(c, least(ref, r))) ELSE least(greatest(quickest, least(c, greatest(ref, r))), c) END AS ultimate FROM f),
g AS (SELECT pipe, nth, c, CASE WHEN at_end THEN c ELSE quick END AS q, CASE WHEN at_end THEN c ELSE quickest END AS qq, CASE WHEN at_end THEN c ELSE ultimate END AS uu FROM u),
p AS (SELECT *, coalesce(lag(c) OVER w, c) AS pc, lag(q) OVER w AS pq, lag(qq) OVER w AS pqq, lag(uu) OVER w AS puu, nth = 1 AS is_first FROM g WINDOW w AS (PARTITION BY pipe ORDER BY nth))
SELECT pipe, nth, round(c + {_C} * (pc - c), 6) AS upstream, round(c + {_C} * (coalesce(pq, c) - q), 6) AS quick, round(c + {_C} * (coalesce(pqq, c) - qq), 6) AS quickest,
 round(c + {_C} * (coalesce(puu, c) - uu), 6) AS ultimate, round(CASE WHEN is_first THEN c ELSE {_C} * pc + (1 - {_C}) * c END, 6) AS characteristics FROM p""",
    "head_curves": f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity * 12 - 300 AS h FROM lineitem),
e AS (SELECT {HEAD[0]}::DOUBLE AS a, {HEAD[0]}::DOUBLE + {HEAD[1]}::DOUBLE * {MOST_FLOW} + {HEAD[2]}::DOUBLE * {MOST_FLOW} * {MOST_FLOW} AS b),
f AS (SELECT *, CASE WHEN h > a THEN (h - a) / -0.005::DOUBLE WHEN h >= b THEN ({HEAD[1]}::DOUBLE + sqrt(pow({HEAD[1]}::DOUBLE, 2) - 4 * {HEAD[2]}::DOUBLE * (a - h))) / (-2 * {HEAD[2]}::DOUBLE)
  ELSE {MOST_FLOW} + (h - b) / (-0.005::DOUBLE / 600) END AS flow FROM r, e)
SELECT l_orderkey, l_linenumber, round(flow, 4) AS flow, round(h, 4) AS back FROM f""",
    "searches": """
WITH r AS (SELECT s_suppkey, abs(s_acctbal) / 20000 + 0.2 AS a FROM supplier)
SELECT s_suppkey, 0.0::DOUBLE AS valley, CASE WHEN 2 * a > 1 THEN 1.0::DOUBLE WHEN 2 * a > 0.5 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS halved, round(cbrt(a), 5) AS root, 0.0::DOUBLE AS largest,
 round(least(1.5, a + least(5 * a, 1.0)) - a, 5) AS stepped FROM r""",
    "pipe_histories": f"""
WITH p AS (SELECT p_partkey AS pipe, p_size * 100.0::DOUBLE + 400 AS length, p_size * 0.5::DOUBLE AS rise, s::INTEGER AS i FROM part, range(3) AS t(s)),
v AS (SELECT *, (0.05::DOUBLE + i * 0.1::DOUBLE) / ({math.pi}::DOUBLE * 0.25::DOUBLE / 4) AS v FROM p),
r AS (SELECT *, v * 0.5::DOUBLE / 1.2e-5::DOUBLE AS re FROM v)
SELECT pipe, i::BIGINT AS step, round(5e6 - (({_ISAEV.format(k="2e-4")}) / 0.5::DOUBLE * 860 * v * v / 2 + 860 * 9.81::DOUBLE * rise / length) * length, 2) AS p_out FROM r""",
    "thermal_histories": f"""
WITH k AS (SELECT {THERMAL_FLOW}::DOUBLE / ({math.pi}::DOUBLE * 0.25::DOUBLE / 4) AS v), r AS (SELECT *, v * 0.5::DOUBLE / 1e-5::DOUBLE AS re FROM k),
l AS (SELECT *, {_ISAEV.format(k="2e-4")} AS lam FROM r),
t AS (SELECT *, 280 + lam * 850 * pow(v, 3) / (8 * {TRANSFER}::DOUBLE) AS tends, 4 * {TRANSFER}::DOUBLE * ({THERMAL_LENGTH / THERMAL_CELLS}::DOUBLE / v) / (850 * 2000 * 0.5::DOUBLE) AS rate FROM l)
SELECT s_suppkey AS pipe, i::BIGINT AS step, round(tends + (290 + abs(s_acctbal) / 500 - tends) * exp(-rate * least(i, {THERMAL_CELLS})), 6) AS t_out, round(5e6 - lam / 0.5::DOUBLE * 850 * v * v / 2 * {THERMAL_LENGTH}::DOUBLE, 2) AS p_out
FROM supplier, range(15) AS x(i), t""",
    "euler_steps": """
WITH f AS (SELECT user_id, arg_min(value, ts) AS s FROM events GROUP BY 1)
SELECT user_id, round(s * pow(0.9::DOUBLE, 8), 6) AS plain, round(s * pow(1 - 0.1::DOUBLE * (1 + 0.9::DOUBLE) / 2, 8), 6) AS corrected FROM f""",
    "redundant_parts": """
SELECT s_nationkey AS part, n + 5 AS n_meters, m AS n_ends, n + 5 >= m AS is_redundant
FROM (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) JOIN (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS m FROM customer GROUP BY 1) ON s_nationkey = c_nationkey""",
    "cuts_turned": """
SELECT l_orderkey, l_linenumber, (l_linestatus = 'O') <> (l_extendedprice < 30000) AS is_sink, round(abs(l_extendedprice - 30000), 2) AS flow FROM lineitem""",
    "cycle_count": f"""
WITH RECURSIVE {strong_sql(0.8)}, v AS (SELECT DISTINCT u AS vertex FROM both_ways),
reach AS (SELECT vertex, vertex AS root FROM v UNION SELECT b.v, reach.root FROM reach JOIN both_ways AS b ON b.u = reach.vertex),
parts AS (SELECT count(DISTINCT r) AS n FROM (SELECT vertex, min(root) AS r FROM reach GROUP BY vertex))
SELECT (SELECT count(*) FROM e) - (SELECT count(*) FROM v) + n AS n_cycles, true AS are_simple FROM parts""",
    "nested_cycles": f"""
WITH RECURSIVE {strong_sql(0.93)}, {BLOCKS_SQL} SELECT edge, block AS nest FROM blocks WHERE NOT is_bridge""",
    "zero_flow_split": f"""
WITH RECURSIVE {GATED_SQL} SELECT vertex, bool_or(is_flow) AS carries_flow FROM placed, unnest([from_v, to_v]) AS t(vertex) WHERE vertex IS NOT NULL GROUP BY vertex""",
    "zero_flow_edges": f"WITH RECURSIVE {GATED_SQL} SELECT edge, half, is_zero, is_flow FROM placed",
    "zero_flow_members": f"""
WITH RECURSIVE {GATED_SQL}, spots AS (SELECT DISTINCT is_zero, part, vertex FROM placed, unnest([from_v, to_v]) AS t(vertex) WHERE vertex IS NOT NULL)
SELECT count(DISTINCT (is_zero, part)) AS n_subgraphs, count(*) AS n_places, (SELECT count(*) FROM placed WHERE to_v IS NOT NULL) AS n_same FROM spots""",
    "loop_transport": """
WITH d AS (SELECT CAST(l_shipdate AS DATE) AS t, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'N') AS b, sum(l_quantity) FILTER (l_returnflag = 'R') / 1000 AS c FROM lineitem GROUP BY 1),
f AS (SELECT *, (t - DATE '1990-01-01')::BIGINT AS step, a - c AS through FROM d WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)
SELECT step, name, round(CASE name WHEN 'p1' THEN (through * 800 + b * 900) / (through + b) ELSE 800 END, 6) AS density FROM f, (VALUES ('p1'), ('s3'), ('b')) AS n(name)""",
    "confident_places": """
SELECT user_id AS place, count(*) AS n_all, count(*) FILTER (event_type = 'purchase') AS n, min(event_id) FILTER (event_type = 'purchase') AS first FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase') > 0""",
    "viscosity_and_trust": """
WITH r AS (SELECT l_orderkey AS v, CASE l_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN l_quantity * 1e-12::DOUBLE ELSE l_quantity END AS w, l_tax * 1.2345679::DOUBLE + 0.7::DOUBLE AS x FROM lineitem),
s AS (SELECT v, count(*) AS n, max(x) AS one, abs(sum(w)) < 1e-8::DOUBLE AS tiny, sum((w + 1e-8::DOUBLE) * x) / sum(w + 1e-8::DOUBLE) AS moved, sum(w * x) / nullif(sum(w), 0) AS mean FROM r GROUP BY v)
SELECT v AS vertex, round(CASE WHEN n = 1 THEN one WHEN tiny THEN moved ELSE mean END, 6) AS density FROM s""",
    "friction_identified": "SELECT 1.3::DOUBLE AS factor, 'converged' AS outcome",
}
