"""Small metered networks whose histories are the days of the line items, and comparisons of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import balance, compare, flows, identify, transport
from tidewright.operators.transport import Edge
from tidewright.plans.tables import table

#: Two inlets meet, a loop of two pipes follows, then a meter, a branch and the outlet.
CHAIN = [("s1", None, 0), ("u1", 0, 1), ("s2", None, 1), ("p1", 1, 2), ("p2", 1, 2), ("m", 2, 3), ("s3", 3, None), ("d", 3, None)]
PIPES = [Edge("s1", "source", None, 0), Edge("u1", "lumped", 0, 1), Edge("s2", "source", None, 1), Edge("p", "pipe", 1, 2, 2000.0, 0.7), Edge("d", "source", 2, None)]


def _daily(spark, sf_dir):
    """meters(t, edge, value): what was shipped each day by return flag."""
    names = F.create_map(*[F.lit(x) for x in ("A", "s1", "N", "s2", "R", "s3")])
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("t"), names[F.col("l_returnflag")].alias("edge")).agg(F.sum("l_quantity").alias("value"))


def flows_from_meters(spark, sf_dir):
    """Every edge's flow each day with a meter for all ends but one, as compiled through the loop."""
    known, _, _ = balance.compile_block_flows(CHAIN, ["s1", "s2", "s3"], halve_pairs=True)
    return flows.flows_of(_daily(spark, sf_dir), known).select("t", "edge", F.round("flow", 6).alias("flow"))


def balanced_network(spark, sf_dir):
    """Days of a network with two balances, reconciled together."""
    days = _daily(spark, sf_dir)
    total = days.groupBy("t").agg(F.sum(F.when(F.col("edge") != "s3", F.col("value"))).alias("value"), F.sum("value").alias("all"))
    middle = total.select("t", F.lit("m").alias("edge"), (F.col("value") * 1.01).alias("value")).union(total.select("t", F.lit("d"), F.col("all") * 0.4)).filter("value is not null")
    return balance.analysed(days.union(middle).withColumnRenamed("value", "measured"), CHAIN).select("t", "edge", F.round("corrected", 6).alias("corrected"), (F.round("delta", 6) + 0.0).alias("delta"))


def steady_transport(spark, sf_dir):
    """Density of what leaves the network each day."""
    meters = _daily(spark, sf_dir).filter("edge <> 's3'").select(F.datediff("t", F.lit("1990-01-01").cast("date")).cast("long").alias("step"), F.col("edge").alias("name"), F.col("value").alias("flow"))
    whole = meters.join(meters.groupBy("step").count().filter("count = 2").select("step"), "step")
    entering = spark.createDataFrame([("s1", 800.0), ("s2", 900.0)], "name string, nominal double")
    rows, _, _ = transport.metered_transport(PIPES, whole, entering)
    return rows.filter("name = 'd'").select("step", F.round("outlet", 6).alias("density"), "confident")


def state_versions(spark, sf_dir):
    """Runs of hours between switchings of users' objects, and what is shut in each."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long")
    controls = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy(hour.alias("step"), F.col("user_id").cast("string").alias("name")).agg((F.max("value") > 20).alias("is_opened"))
    steps = table(spark, sf_dir, "events").select(hour.alias("step")).distinct()
    return transport.versions(controls, steps).select("version", "step_from", "step_to", F.size("closed").cast("long").alias("n_closed"), F.concat_ws(",", "closed").alias("closed"))


def error_histogram(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("computed"), (F.col("l_linenumber") * 7.0).alias("measured"))
    return compare.error_histogram(pairs, 10).select(F.col("bin").cast("long").alias("bin"), F.round("low", 6).alias("low"), "n")


def converged_share(spark, sf_dir):
    scores = table(spark, sf_dir, "part").select((F.col("p_size") % 6).alias("score"))
    return identify.converged_share(scores).select(F.col("score").cast("long").alias("score"), F.round("per_cent", 6).alias("per_cent"), "is_converged")


def confident_series(spark, sf_dir):
    """Each order's confident values beside those of its lines."""
    computed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderstatus") == "F", compare.CONFIDENT).otherwise("unused").alias("status"))
    measured = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("place")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    return compare.confident_pairs(computed, measured, ["place"])


QUERIES = {f.__name__: f for f in (flows_from_meters, balanced_network, steady_transport, state_versions, error_histogram, converged_share, confident_series)}

_DAILY = "daily AS (SELECT CAST(l_shipdate AS DATE) AS t, CASE l_returnflag WHEN 'A' THEN 's1' WHEN 'N' THEN 's2' ELSE 's3' END AS edge, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"

ORACLES = {
    "flows_from_meters": f"""
WITH {_DAILY},
c(edge, meter, k) AS (VALUES ('s1', 's1', 1.0), ('u1', 's1', 1.0), ('s2', 's2', 1.0), ('p1', 's1', 0.5), ('p1', 's2', 0.5), ('p2', 's1', 0.5), ('p2', 's2', 0.5),
  ('m', 's1', 1.0), ('m', 's2', 1.0), ('s3', 's3', 1.0), ('d', 's1', 1.0), ('d', 's2', 1.0), ('d', 's3', -1.0))
SELECT t, c.edge, round(sum(k::DOUBLE * value), 6) AS flow FROM daily JOIN c ON daily.edge = c.meter GROUP BY t, c.edge""",
    "balanced_network": f"""
WITH {_DAILY},
w AS (SELECT t, coalesce(sum(value) FILTER (edge = 's1'), 0) AS a, coalesce(sum(value) FILTER (edge = 's2'), 0) AS b, coalesce(sum(value) FILTER (edge = 's3'), 0) AS c,
             sum(value) FILTER (edge <> 's3') * 1.01::DOUBLE AS m, sum(value) * 0.4::DOUBLE AS d FROM daily GROUP BY t),
z AS (SELECT *, coalesce(m, 0) AS mm, a + b - coalesce(m, 0) AS r1, coalesce(m, 0) - c - d AS r2 FROM w),
k AS (SELECT *, a + b + mm AS k11, mm + c + d AS k22 FROM z),
l AS (SELECT *, CASE WHEN k11 = 0 THEN 0 ELSE (r1 * k22 + mm * r2) / (k11 * k22 - mm * mm) END AS l1, CASE WHEN k11 = 0 THEN r2 / k22 ELSE (k11 * r2 + mm * r1) / (k11 * k22 - mm * mm) END AS l2 FROM k),
x AS (SELECT t, edge, measured, shift FROM l, LATERAL (VALUES ('s1', a, -a * l1), ('s2', b, -b * l1), ('s3', c, c * l2), ('m', mm, mm * (l1 - l2)), ('d', d, d * l2)) AS v(edge, measured, shift))
SELECT x.t, x.edge, round(measured + shift, 6) AS corrected, round(shift, 6) + 0.0 AS delta FROM x LEFT JOIN daily ON daily.t = x.t AND daily.edge = x.edge
WHERE daily.edge IS NOT NULL OR (x.edge = 'm' AND measured <> 0) OR x.edge = 'd'""",
    "steady_transport": f"""
WITH {_DAILY}, w AS (SELECT t, sum(value) FILTER (edge = 's1') AS a, sum(value) FILTER (edge = 's2') AS b FROM daily GROUP BY t)
SELECT (t - DATE '1990-01-01')::BIGINT AS step, round((a * 800 + b * 900) / (a + b), 6) AS density, false AS confident FROM w WHERE a IS NOT NULL AND b IS NOT NULL""",
    "state_versions": """
WITH e AS (SELECT epoch_us(ts) // 3600000000 AS step, user_id, event_type, value FROM events),
c AS (SELECT step, user_id::VARCHAR AS name, max(value) > 20 AS is_opened FROM e WHERE event_type = 'error' GROUP BY 1, 2),
s AS (SELECT step FROM c UNION SELECT min(step) FROM e),
r AS (SELECT row_number() OVER (ORDER BY step) - 1 AS version, step AS step_from, coalesce(lead(step) OVER (ORDER BY step) - 1, (SELECT max(step) FROM e)) AS step_to FROM s),
h AS (SELECT *, lead(step) OVER (PARTITION BY name ORDER BY step) AS until FROM c),
k AS (SELECT version, count(name) AS n, string_agg(name, ',' ORDER BY name) AS closed FROM r JOIN h ON h.step <= r.step_from AND (until IS NULL OR until > r.step_from) WHERE NOT is_opened GROUP BY version)
SELECT r.version, step_from, step_to, coalesce(n, 0) AS n_closed, coalesce(closed, '') AS closed FROM r LEFT JOIN k ON r.version = k.version""",
    "error_histogram": """
WITH e AS (SELECT l_quantity - l_linenumber * 7.0::DOUBLE AS x FROM lineitem), w AS (SELECT min(x) AS a, max(x) AS b, (max(x) - min(x)) / 10 AS w FROM e),
p AS (SELECT least(floor((x - a) / w), 9)::BIGINT AS bin, a, w FROM e, w)
SELECT bin, round(any_value(a + bin * w), 6) AS low, count(*) AS n FROM p GROUP BY bin""",
    "converged_share": """
SELECT (p_size % 6)::BIGINT AS score, round(100 * count(*)::DOUBLE / (SELECT count(*) FROM part), 6) AS per_cent, p_size % 6 IN (3, 4, 5) AS is_converged FROM part GROUP BY p_size % 6""",
    "confident_series": """
SELECT o_orderkey AS place, o_totalprice AS computed, m.measured
FROM orders JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS measured FROM lineitem GROUP BY 1) m ON o_orderkey = m.l_orderkey WHERE o_orderstatus = 'F'""",
}
