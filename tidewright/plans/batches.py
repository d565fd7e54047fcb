"""Batches of a small network over months: suppliers are scenarios, what they ship is what flows out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import batches
from tidewright.plans.tables import table

RESISTANCE, SUPPLY = 4.0e3, 2.0e6
#: A source of given pressure, two resistances with a gate between them, an outlet of given flow and one behind a gate that is shut.
NETWORK = batches.describe(
    {"Supply": {"to": 0}, "First": {"from": 0, "to": 1}, "Second": {"from": 1, "to": 2}, "Demand": {"from": 2}, "Gate": {"from": 1, "to": 3}, "Spare": {"from": 3}},
    {"resistances": {"First": {"resistance": RESISTANCE}, "Second": {"resistance": 2 * RESISTANCE}}, "valves": {"Gate": {"initial_opening": 0.0, "xi": 1.0, "diameter": 0.5}}, "sources": {"Supply": {"pressure": SUPPLY}, "Demand": {"std_volflow": 0.0}, "Spare": {"std_volflow": 0.0}}},
)


def _demand(spark, sf_dir):
    """(scenario, step, q): what a supplier ships in each month, a step, with nothing in the months that are multiples of 5."""
    month = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("scenario"), month.cast("long").alias("step")).agg((F.sum("l_quantity") / 400).alias("q"))
    return rows.withColumn("q", F.when(F.col("step") % 5 != 0, F.col("q")))


def _history(spark, sf_dir):
    rows = _demand(spark, sf_dir).withColumn("name", F.lit("Demand"))
    told = batches.controls_json(rows.filter("q is not null"), "sources", {"q": "std_vol_flow"}, ["scenario", "step"])
    return rows.select("scenario", "step").join(told, ["scenario", "step"], "left")


def hydro_batch(spark, sf_dir):
    """Pressures at the demand; months without a control keep what was asked for before."""
    found = batches.run(_history(spark, sf_dir), *NETWORK)
    return found.filter("place_kind = 'vertex' and place in ('1', '2')").select("scenario", "step", "place", F.round("pressure", 1).alias("pressure"), "converged")


def control_documents(spark, sf_dir):
    return _history(spark, sf_dir).select("scenario", "step", F.round(F.get_json_object("controls", "$.controls.sources.Demand.std_vol_flow").cast("double"), 6).alias("q"))


def constant_layer(spark, sf_dir):
    return batches.constant(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 7)


def calendar_times(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return rows.select("o_orderkey", batches.calendar("2024-01-01", 0.7, "o_orderkey").alias("t"))


QUERIES = {f.__name__: f for f in (hydro_batch, control_documents, constant_layer, calendar_times)}

_DEMAND = """d AS (
  SELECT l_suppkey AS scenario, ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1)::BIGINT AS step, sum(l_quantity) / 400 AS q FROM lineitem GROUP BY 1, 2),
c AS (SELECT scenario, step, CASE WHEN step % 5 <> 0 THEN q END AS q FROM d)"""

ORACLES = {
    "hydro_batch": f"""
WITH {_DEMAND}, h AS (SELECT scenario, step, coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY scenario ORDER BY step), 0) AS q FROM c)
SELECT scenario, step, place, round({SUPPLY}::DOUBLE - CASE place WHEN '1' THEN {RESISTANCE}::DOUBLE ELSE {3 * RESISTANCE}::DOUBLE END * q * q, 1) AS pressure, true AS converged
FROM h, (VALUES ('1'), ('2')) AS p(place)""",
    "control_documents": f"WITH {_DEMAND} SELECT scenario, step, round(q, 6) AS q FROM c",
    "constant_layer": "SELECT n_nationkey, n_name, step::BIGINT AS step FROM nation, range(7) AS t(step)",
    "calendar_times": "SELECT o_orderkey, TIMESTAMP '2024-01-01' + to_seconds(floor(o_orderkey * 0.7::DOUBLE + 0.5)::BIGINT) AS t FROM orders",
}
