"""Mass-balance reconciliation of metered flows on table-shaped networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import flows
from tidewright.plans.tables import NET_SQL, net, table


def _meters(spark, sf_dir):
    """One balance a day: meters of line status O enter (+1), the others leave (-1)."""
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("measured"), F.when(F.col("l_linestatus") == "O", F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign")
    )


def flow_reconcile_single(spark, sf_dir):
    """Daily sums are grouped with map-side combine and meet the meters in an equi-join, so that AQE can split a hot day."""
    done = flows.reconciled_single(_meters(spark, sf_dir), ["day"])
    return done.select("day", "l_orderkey", "l_linenumber", "measured", F.round("corrected", 6).alias("corrected"), F.round("delta", 6).alias("delta"))


def small_flow_exclusion(spark, sf_dir):
    return flows.adjustable(_meters(spark, sf_dir), ["day"], 0.1).select("day", "l_orderkey", "l_linenumber", "adjusted")


def flow_correction_factors(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("place"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("value"))
    factors = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("place"), (1 + F.col("s_acctbal") / 100_000).alias("factor"))
    return flows.corrected_by_factors(values, factors, "place").withColumn("value", F.round("value", 8))


def flow_imbalance(spark, sf_dir):
    return flows.imbalances(net(spark, sf_dir)).withColumn("imbalance", F.round("imbalance", 3))


def pivot_balance_report(spark, sf_dir):
    """A row a day with each return flag's flow, reconciled flow and difference, and the day's residual."""
    flags = ("A", "N", "R")
    done = flows.reconciled_single(_meters(spark, sf_dir), ["day"])
    columns = [F.round(F.sum(F.when(F.col("l_returnflag") == f, F.col(c))), 7).alias(f"q_{f.lower()}{s}") for f in flags for c, s in (("measured", ""), ("corrected", "_mle"), ("delta", "_delta"))]
    return done.groupBy("day").agg(*columns, F.round(F.max("residual"), 3).alias("residual"))


QUERIES = {f.__name__: f for f in (flow_reconcile_single, small_flow_exclusion, flow_correction_factors, flow_imbalance, pivot_balance_report)}

_METERS_SQL = """m AS (
  SELECT CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, l_returnflag, l_quantity AS measured,
         CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign, greatest(abs(l_quantity), 1e-8::DOUBLE) AS scale
  FROM lineitem),
d AS (SELECT day, sum(sign * measured) AS residual, sum(scale) AS scales, max(abs(measured)) AS largest FROM m GROUP BY day),
x AS (SELECT m.*, residual, largest, measured - sign * scale * residual / scales AS corrected, -(sign * scale * residual / scales) AS delta FROM m JOIN d ON m.day = d.day)"""

ORACLES = {
    "flow_reconcile_single": f"WITH {_METERS_SQL} SELECT day, l_orderkey, l_linenumber, measured, round(corrected, 6) AS corrected, round(delta, 6) AS delta FROM x",
    "small_flow_exclusion": f"WITH {_METERS_SQL} SELECT day, l_orderkey, l_linenumber, abs(measured) >= 0.1::DOUBLE * largest AS adjusted FROM x",
    "flow_correction_factors": """
SELECT l_suppkey AS place, l_orderkey, l_linenumber, round(l_quantity * coalesce(1 + s_acctbal / 100000, 1.0::DOUBLE), 8) AS value
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0""",
    "flow_imbalance": f"""
WITH {NET_SQL}, s AS (SELECT from_v AS vertex, -flow AS signed FROM net UNION ALL SELECT to_v, flow FROM net)
SELECT vertex, round(sum(signed), 3) AS imbalance FROM s GROUP BY vertex""",
    "pivot_balance_report": f"""
WITH {_METERS_SQL}
SELECT day, {", ".join(f"round(sum({c}) FILTER (l_returnflag = '{f}'), 7) AS q_{f.lower()}{s}" for f in "ANR" for c, s in (("measured", ""), ("corrected", "_mle"), ("delta", "_delta")))},
       round(max(residual), 3) AS residual
FROM x GROUP BY day""",
}
