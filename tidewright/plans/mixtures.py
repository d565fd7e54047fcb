"""Mixtures of the lines that each supplier ships, and of readings of one kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import mixing
from tidewright.plans.series import QUANTITY_OF
from tidewright.plans.tables import table


def _inlets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("vertex"), F.col("l_quantity").alias("flow"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("density"), (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("viscosity"), (F.col("l_tax") < 0.08).alias("confident")
    )


def endo_average(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for kv in QUANTITY_OF.items() for x in kv])
    readings = table(spark, sf_dir, "events").select(names[F.col("event_type")].alias("mtype"), "value")
    found = mixing.averages(readings, {"density": 850.0, "viscosity_working": 1e-5, "temperature": 300.0, "sulfur": 0.5, "improver": 0.0})
    return found.withColumn("value", F.round("value", 6))


def mix_density(spark, sf_dir):
    return mixing.mixed(_inlets(spark, sf_dir)).withColumn("density", F.round("density", 6))


def mix_viscosity_km(spark, sf_dir):
    return mixing.mixed(_inlets(spark, sf_dir), density=None, viscosity="viscosity").withColumn("viscosity", F.round("viscosity", 6))


def mix_confidence(spark, sf_dir):
    return mixing.mixed(_inlets(spark, sf_dir).withColumn("confident", F.col("confident") | (F.col("flow") > 5)), density=None, confidence="confident")


def overwrite_status(spark, sf_dir):
    computed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "F").alias("confident"))
    measured = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("place"), F.col("l_extendedprice").alias("value"), F.struct("l_linenumber", "l_extendedprice").alias("seq"))
    return mixing.overwritten(computed, measured, ["place"])


QUERIES = {f.__name__: f for f in (endo_average, mix_density, mix_viscosity_km, mix_confidence, overwrite_status)}

ORACLES = {
    "endo_average": """
WITH r AS (
  SELECT CASE event_type WHEN 'purchase' THEN 'density' WHEN 'error' THEN 'temperature' WHEN 'view' THEN 'viscosity_working' END AS family, avg(value) AS mean
  FROM events WHERE value IS NOT NULL GROUP BY 1),
d(family, usual) AS (VALUES ('density', 850.0::DOUBLE), ('viscosity_working', 1e-5::DOUBLE), ('temperature', 300.0::DOUBLE), ('sulfur', 0.5::DOUBLE), ('improver', 0.0::DOUBLE))
SELECT d.family, round(coalesce(mean, usual), 6) AS value, false AS confident FROM d LEFT JOIN r ON d.family = r.family""",
    "mix_density": """
SELECT l_suppkey AS vertex, round(CASE WHEN count(*) = 1 THEN max(l_extendedprice / l_quantity) ELSE sum(l_quantity * (l_extendedprice / l_quantity)) / sum(l_quantity) END, 6) AS density
FROM lineitem GROUP BY 1""",
    "mix_viscosity_km": """
WITH x AS (SELECT l_suppkey AS vertex, l_quantity AS w, cbrt(l_extendedprice / l_quantity / 100) AS r FROM lineitem)
SELECT vertex, round(pow(CASE WHEN count(*) = 1 THEN max(r) ELSE sum(w * r) / sum(w) END, 3), 6) AS viscosity FROM x GROUP BY vertex""",
    "mix_confidence": "SELECT l_suppkey AS vertex, bool_and(l_tax < 0.08 OR l_quantity > 5) AS confident FROM lineitem GROUP BY 1",
    "overwrite_status": """
WITH m AS (
  SELECT l_orderkey AS place, l_extendedprice AS measured FROM lineitem WHERE l_returnflag = 'R'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice DESC) = 1)
SELECT o_orderkey AS place, coalesce(measured, o_totalprice) AS value, measured IS NOT NULL OR o_orderstatus = 'F' AS confident,
       CASE WHEN measured IS NOT NULL THEN o_totalprice END AS replaced,
       CASE WHEN measured IS NULL THEN 'unused' WHEN o_orderstatus = 'F' THEN 'confident_calculation' ELSE 'inconfident_calculation' END AS status
FROM orders LEFT JOIN m ON o_orderkey = m.place""",
}
