"""Pipe laws on table-shaped series: grids, advection steps, pressure profiles and characteristic curves."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions import scalar
from tidewright.plans.tables import table


def _cells(spark, sf_dir):
    """A user's events as the cells of a pipe, in order of time."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("pipe"), "ts", (F.col("value") + 800).alias("density"), (F.col("value") + 50).alias("length"))


def pipe_uniform_grid(spark, sf_dir):
    """Points of each part as a pipe of p_size * 37 metres in steps of at least 200 metres."""
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37.0).alias("length"))
    n = F.greatest(F.lit(1), F.floor(F.col("length") / 200)).cast("int")
    step = F.greatest(F.lit(200.0), F.col("length") / n)
    return parts.select("p_partkey", step.alias("step"), F.explode(F.sequence(F.lit(0), n)).alias("point")).select("p_partkey", F.col("point").cast("long").alias("point"), F.round(F.col("point") * F.col("step"), 6).alias("x"))


def moc_shift_cr1(spark, sf_dir):
    """At a Courant number of 1 the outlet repeats the inlet as many steps later as the pipe has cells."""
    order = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, sf_dir, "events").select("user_id", "ts", F.lag("value", 5).over(order).alias("outlet"))


def upstream_one_step(spark, sf_dir):
    """One donor-cell step at a Courant number of 0.4, with the first cell's value at the inlet."""
    order = Window.partitionBy("pipe").orderBy("ts")
    before = F.coalesce(F.lag("density").over(order), F.first("density").over(order))
    return _cells(spark, sf_dir).select("pipe", "ts", F.round(F.col("density") + 0.4 * (before - F.col("density")), 6).alias("density"))


def pressure_profile_qp(spark, sf_dir):
    """Pressure after each cell from 6 MPa on at a flow of 0.5 m3/s through 0.7 m pipes: a running sum, as the gradient doesn't depend on pressure."""
    order = Window.partitionBy("pipe").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drop = scalar.pressure_gradient(0.5, "density", 1e-5, 0.7, 1.4e-4, (F.pmod(F.floor("density"), F.lit(3)) - 1) * 0.01) * F.col("length")
    return _cells(spark, sf_dir).select("pipe", "ts", F.round(6e6 + F.sum(drop).over(order), 3).alias("pressure"))


def local_resistance_flow(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 100).alias("drop"))
    flow = scalar.local_resistance_flow("drop", F.lit(0.0), 850.0, 0.2, 2.5)
    return rows.select("c_custkey", F.round(flow, 6).alias("flow"), F.round(scalar.local_resistance_loss(flow, 850.0, 0.2, 2.5), 3).alias("loss"))


def friction_isaev(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 8).alias("re"))
    return rows.select("l_orderkey", "l_linenumber", F.round(scalar.friction_isaev("re", 2e-4), 6).alias("isaev"), F.round(scalar.friction_altshul("re", 2e-4), 6).alias("altshul"))


def poly_head_curve(spark, sf_dir):
    """Head of a running pump over flow, and the integral of the curve."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 60).alias("q"))
    curve = F.array(*[F.lit(c) for c in (250.0, -0.012, -2.1e-6)])
    return rows.select("l_orderkey", "l_linenumber", F.round(scalar.polyval(curve, "q"), 6).alias("head"), F.round(scalar.polyval(scalar.poly_integral(curve), "q"), 3).alias("integral"))


def viscosity_filonov(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (273.15 + F.col("value") / 2).alias("t"))
    table_model = scalar.viscosity_model(F.lit(30.0), F.lit(12.0), F.lit(5.0))
    return rows.select("event_id", F.round(scalar.viscosity_filonov(10.0, 293.15, 0.03, "t"), 6).alias("filonov"), F.round(scalar.viscosity_of(table_model, "t"), 6).alias("vogel"))


QUERIES = {f.__name__: f for f in (pipe_uniform_grid, moc_shift_cr1, upstream_one_step, pressure_profile_qp, local_resistance_flow, friction_isaev, poly_head_curve, viscosity_filonov)}

_AREA = f"({math.pi}::DOUBLE * {{d}} * {{d}} / 4)"
_ISAEV = """CASE WHEN re < 1 THEN 64.0 WHEN re < 2320 THEN 64 / re
  WHEN re < 4000 THEN 64 / re * (1 - (1 - exp(-0.002 * (re - 2320)))) + 0.3164 / pow(re, 0.25) * (1 - exp(-0.002 * (re - 2320)))
  ELSE 1 / pow(-1.8 * log10(6.8 / re + pow({k}::DOUBLE / 3.7, 1.1)), 2) END"""

ORACLES = {
    "pipe_uniform_grid": """
WITH p AS (SELECT p_partkey, p_size * 37.0::DOUBLE AS length, greatest(1, floor(p_size * 37.0::DOUBLE / 200))::INTEGER AS n FROM part)
SELECT p_partkey, i::BIGINT AS point, round(i * greatest(200.0::DOUBLE, length / n), 6) AS x FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM p)""",
    "moc_shift_cr1": "SELECT user_id, ts, lag(value, 5) OVER (PARTITION BY user_id ORDER BY ts) AS outlet FROM events",
    "upstream_one_step": """
WITH c AS (SELECT user_id AS pipe, ts, value + 800 AS density FROM events)
SELECT pipe, ts, round(density + 0.4::DOUBLE * (coalesce(lag(density) OVER w, density) - density), 6) AS density FROM c WINDOW w AS (PARTITION BY pipe ORDER BY ts)""",
    "pressure_profile_qp": f"""
WITH c AS (SELECT user_id AS pipe, ts, value + 800 AS rho, value + 50 AS length, 0.5::DOUBLE / {_AREA.format(d="0.7::DOUBLE")} AS v FROM events),
r AS (SELECT *, v * 0.7::DOUBLE / 1e-5::DOUBLE AS re FROM c),
g AS (SELECT *, -({_ISAEV.format(k="1.4e-4")}) / 0.7::DOUBLE * rho * v * v / 2 - rho * 9.81::DOUBLE * ((floor(rho)::BIGINT % 3 - 1) * 0.01::DOUBLE) AS slope FROM r)
SELECT pipe, ts, round(6e6 + sum(slope * length) OVER (PARTITION BY pipe ORDER BY ts ROWS UNBOUNDED PRECEDING), 3) AS pressure FROM g""",
    "local_resistance_flow": f"""
WITH q AS (
  SELECT c_custkey, {_AREA.format(d="0.2::DOUBLE")} AS s, {_AREA.format(d="0.2::DOUBLE")} * sign(c_acctbal) * sqrt(abs(2 * (c_acctbal * 100) / (2.5::DOUBLE * 850::DOUBLE))) AS flow
  FROM customer)
SELECT c_custkey, round(flow, 6) AS flow, round(2.5::DOUBLE * 850 / 2 * sign(flow) * (flow / s) * (flow / s), 3) AS loss FROM q""",
    "friction_isaev": f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 8 AS re FROM lineitem)
SELECT l_orderkey, l_linenumber, round({_ISAEV.format(k="2e-4")}, 6) AS isaev, round(0.11::DOUBLE * pow(2e-4::DOUBLE + 68 / re, 0.25), 6) AS altshul FROM r""",
    "poly_head_curve": """
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity * 60 AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, round(250 + q * (-0.012::DOUBLE + q * -2.1e-6::DOUBLE), 6) AS head,
       round(q * (250 + q * (-0.012::DOUBLE / 2 + q * (-2.1e-6::DOUBLE / 3))), 3) AS integral FROM r""",
    "viscosity_filonov": """
WITH r AS (SELECT event_id, 273.15::DOUBLE + value / 2 AS t FROM events),
c AS (SELECT ln(30.0::DOUBLE / 12) AS f1, ln(12.0::DOUBLE / 5) AS f2),
k AS (SELECT *, 1.5::DOUBLE * f1 / f2 AS bend FROM c),
m AS (SELECT *, (323.15::DOUBLE - bend * 273.15::DOUBLE) / (1 - bend) AS theta FROM k)
SELECT event_id, round(10 * exp(-0.03::DOUBLE * (t - 293.15::DOUBLE)), 6) AS filonov,
       round(5 * pow(5.0::DOUBLE / 30, 1 / (bend - 1)) * exp((273.15::DOUBLE - theta) * (293.15::DOUBLE - theta) / 20 * f1 / (t - theta)), 6) AS vogel
FROM r, m""",
}
