"""Batches prepared from the events: users are tags, bound to one or two objects each; purchases switch and open."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import prepared
from tidewright.plans.tables import PERIOD_SQL, TAGS_SQL, table, tags

STEP = 3600
KINDS = ["click", "error", "purchase", "signup", "view"]


def _bindings(spark, sf_dir):
    """Every user measures a flow in m3/h; every third one's tag is a density too."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("tag")).distinct()
    flow = users.select("tag", F.concat(F.lit("line "), F.col("tag").cast("string")).alias("name"), F.lit("vol_flow_std").alias("mtype"), F.lit("m3/h").alias("dim"))
    density = users.filter("tag % 3 = 0").select("tag", F.concat(F.lit("tank "), F.col("tag").cast("string")).alias("name"), F.lit("density_std").alias("mtype"), F.lit("kg/m3").alias("dim"))
    return flow.unionByName(density)


def _purchases(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("tag"), F.concat(F.lit("valve "), F.col("user_id").cast("string")).alias("name"), F.col("ts").cast("timestamp").alias("ts"), "value")


def prepared_transport(spark, sf_dir):
    """Flows and densities at every hour that all users cover, and states of valves at the steps that they are told in."""
    switched = _purchases(spark, sf_dir).withColumn("value", (F.col("value") > 50).cast("double"))
    batch = prepared.transport(tags(spark, sf_dir), _bindings(spark, sf_dir), STEP, switched)
    return batch.withColumn("value", F.round("value", 6))


def prepared_hydraulic(spark, sf_dir):
    """Openings of valves on the same grid."""
    span = prepared.bounds(tags(spark, sf_dir))
    opened = _purchases(spark, sf_dir)
    objects = opened.select("name").distinct().withColumn("kind", F.lit("valve"))
    return prepared.hydraulic(span, STEP, opened.withColumn("value", F.col("value") / 100), objects).select("step", "t", "name", "at", F.round("value", 6).alias("opening"))


def referenced_series(spark, sf_dir):
    """Mean values of kinds of events every ten minutes; views are what the others are held against."""
    events = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tag"), F.col("ts").cast("timestamp").alias("ts")).agg(F.avg("value").alias("value"))
    found = prepared.with_reference(events, KINDS, 600)
    return found.select("step", "t", *[F.round(F.get("parameters", i), 6).alias(k) for i, k in enumerate(KINDS[:-1])], F.round("reference", 6).alias("reference"))


QUERIES = {f.__name__: f for f in (prepared_transport, prepared_hydraulic, referenced_series)}

_GRID = f"""{TAGS_SQL}, {PERIOD_SQL},
g AS (SELECT row_number() OVER (ORDER BY t) - 1 AS step, t FROM (SELECT unnest(range(t_start, t_end, INTERVAL {STEP} SECOND)) AS t FROM period)),
told AS (
  SELECT g.step, g.t, 'valve ' || user_id AS name, value, ts FROM events, period, g
  WHERE event_type = 'purchase' AND ts >= t_start AND g.step = least((epoch_us(ts) - epoch_us(t_start)) // {STEP * 1_000_000}, (SELECT max(step) FROM g)))"""

ORACLES = {
    "prepared_transport": f"""
WITH {_GRID},
points AS (SELECT tag, step, t FROM (SELECT DISTINCT tag FROM tags), g),
p AS (SELECT points.*, tags.ts AS pt, tags.value AS pv FROM points ASOF LEFT JOIN tags ON points.tag = tags.tag AND points.t >= tags.ts),
n AS (SELECT points.*, tags.ts AS nt, tags.value AS nv FROM points ASOF LEFT JOIN tags ON points.tag = tags.tag AND points.t <= tags.ts),
r AS (SELECT p.tag, p.step, p.t, CASE WHEN pt = nt THEN pv ELSE pv + (nv - pv) * ((epoch_us(p.t) - epoch_us(pt))::DOUBLE / (epoch_us(nt) - epoch_us(pt))::DOUBLE) END AS v
  FROM p JOIN n ON p.tag = n.tag AND p.step = n.step)
SELECT step, t, 'flow' AS role, 'line ' || tag AS name, 'vol_flow_std' AS mtype, round(v / 3600, 6) AS value, NULL::TIMESTAMP AS at FROM r
UNION ALL SELECT step, t, 'endogenous', 'tank ' || tag, 'density_std', round(v, 6), NULL FROM r WHERE tag % 3 = 0
UNION ALL SELECT step, t, 'state', name, NULL, (value > 50)::DOUBLE, ts FROM told""",
    "prepared_hydraulic": f"WITH {_GRID} SELECT step, t, name, ts AS at, round(value / 100, 6) AS opening FROM told",
    "referenced_series": """
WITH e AS (SELECT event_type AS tag, ts, avg(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
period AS (SELECT max(a) AS t_start, min(b) AS t_end FROM (SELECT min(ts) AS a, max(ts) AS b FROM e GROUP BY tag)),
g AS (SELECT row_number() OVER (ORDER BY t) - 1 AS step, t FROM (SELECT unnest(range(t_start, t_end, INTERVAL 10 MINUTE)) AS t FROM period)),
points AS (SELECT tag, step, t FROM (SELECT DISTINCT tag FROM e), g),
p AS (SELECT points.*, e.ts AS pt, e.value AS pv FROM points ASOF LEFT JOIN e ON points.tag = e.tag AND points.t >= e.ts),
n AS (SELECT points.*, e.ts AS nt, e.value AS nv FROM points ASOF LEFT JOIN e ON points.tag = e.tag AND points.t <= e.ts),
r AS (SELECT p.tag, p.step, p.t, CASE WHEN pt = nt THEN pv ELSE pv + (nv - pv) * ((epoch_us(p.t) - epoch_us(pt))::DOUBLE / (epoch_us(nt) - epoch_us(pt))::DOUBLE) END AS v
  FROM p JOIN n ON p.tag = n.tag AND p.step = n.step)
SELECT step, t, round(max(v) FILTER (tag = 'click'), 6) AS click, round(max(v) FILTER (tag = 'error'), 6) AS error, round(max(v) FILTER (tag = 'purchase'), 6) AS purchase,
  round(max(v) FILTER (tag = 'signup'), 6) AS signup, round(max(v) FILTER (tag = 'view'), 6) AS reference FROM r GROUP BY step, t""",
}
