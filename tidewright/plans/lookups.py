"""Look-ups in tables of ranges: shipments under way, balances between those of suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import ranges
from tidewright.plans.tables import table


def shipments_under_way(spark, sf_dir):
    """For each line, how many shipments of its part were under way on the day it was shipped, its own among them, and how much they held."""
    lines = table(spark, sf_dir, "lineitem")
    points = lines.select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    held = lines.select("l_partkey", F.col("l_shipdate").alias("since"), F.date_add(F.col("l_shipdate").cast("date"), 30).alias("until"), F.col("l_quantity").alias("quantity"))
    held = held.withColumn("since", F.col("since").cast("date"))
    met = ranges.containing(points.withColumn("day", F.col("l_shipdate").cast("date")).drop("l_shipdate"), held, "day", "since", "until", ["l_partkey"])
    return met.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


def balances_between(spark, sf_dir):
    """Each customer's balance in the range from a supplier's balance of the same nation to the next greater one; those below all have none."""
    steps = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("since")).agg(F.min("s_suppkey").alias("s_suppkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    bounded = ranges.successive(steps, "since", ["nation"], 500.0)
    return ranges.containing(customers, bounded, "c_acctbal", "since", "until", ["nation"]).select("c_custkey", "s_suppkey", "since")


QUERIES = {f.__name__: f for f in (shipments_under_way, balances_between)}

ORACLES = {
    "shipments_under_way": """
SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, count(*) AS n, sum(r.l_quantity) AS quantity
FROM lineitem p JOIN lineitem r ON p.l_partkey = r.l_partkey AND p.l_shipdate::DATE >= r.l_shipdate::DATE AND p.l_shipdate::DATE < r.l_shipdate::DATE + 30 GROUP BY ALL""",
    "balances_between": """
WITH s AS (SELECT s_nationkey, s_acctbal, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY ALL)
SELECT c_custkey, s_suppkey, s_acctbal AS since FROM customer ASOF JOIN s ON c_nationkey = s_nationkey AND c_acctbal >= s_acctbal""",
}
