"""Readings of tags: units, controls, cleaning, grids, look-ups by time, regimes and smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import units
from tidewright.operators import series
from tidewright.plans.tables import PERIOD_SQL, TAGS_SQL, table, tags

#: What the kinds of events stand for in these queries.
UNIT_OF = {"click": "m3/h", "purchase": "kg/m3", "error": "MPa", "signup": "K-C", "view": "kgf/cm2(e)"}
CODE_OF = {"click": 1, "purchase": 3, "signup": 2, "view": 5}
QUANTITY_OF = {"click": "vol_flow_std", "purchase": "density_std", "error": "temperature", "signup": "mass_flow", "view": "viscosity_working"}


def _by_type(mapping: dict):
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col("event_type")]


def tag_read_units(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(units.to_si(F.col("value"), _by_type(UNIT_OF)), 6).alias("si_value"))


def control_code_map(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    return rows.select("event_id", units.open_by_code(_by_type(CODE_OF)).alias("is_opened"))


def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def classify_measurements(spark, sf_dir):
    kind = F.when(units.is_flow(_by_type(QUANTITY_OF)), "flow").otherwise("endogenous")
    return table(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


def clean_range_delta(spark, sf_dir):
    return series.cleaned(tags(spark, sf_dir), 5.0, 95.0, 40.0)


def series_period(spark, sf_dir):
    return series.period(tags(spark, sf_dir))


def time_grid(spark, sf_dir):
    return series.grid(series.period(tags(spark, sf_dir)), 3600)


def _points(spark, sf_dir):
    """Every tag at every hour from the day's start on, as points to look up."""
    rows = tags(spark, sf_dir)
    bounds = rows.agg(F.date_trunc("hour", F.min("ts")).alias("t_start"), F.date_trunc("hour", F.max("ts")).alias("t_end"))
    hours = series.grid(bounds.select("t_start", (F.col("t_end") + F.expr("interval 1 hour")).alias("t_end")), 3600).select("t")
    return rows, rows.select("tag").distinct().crossJoin(hours)  # each tag at each hour is what is asked for


def interp_linear(spark, sf_dir):
    rows, points = _points(spark, sf_dir)
    return series.interpolated(points, rows).select("tag", "t", F.round("value", 6).alias("value"))


def interp_step(spark, sf_dir):
    rows, points = _points(spark, sf_dir)
    return series.interpolated(points, rows, "step").select("tag", "t", "value")


def control_asof_step(spark, sf_dir):
    rows = tags(spark, sf_dir)
    start = rows.agg(F.date_trunc("hour", F.min("ts")).alias("t_start"))
    return rows.join(F.broadcast(start)).select("tag", "ts", series.grid_step(F.col("ts"), F.col("t_start"), 900).alias("step"))


def asof_general(spark, sf_dir):
    orders = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("tag"), F.col("ts").cast("timestamp").alias("t"), "event_id")
    views = table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").alias("tag"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return series.as_of(orders, views).select("event_id", "as_of_t", "value")


def source_switch_edges(spark, sf_dir):
    return series.switchings(tags(spark, sf_dir), 25.0)


def regime_hourly(spark, sf_dir):
    return series.regimes(series.grid(series.period(tags(spark, sf_dir)), 900), 900).select("step", "t")


def sma_centered(spark, sf_dir):
    return series.centred_mean(tags(spark, sf_dir), 5).select("tag", "ts", F.round("mean", 6).alias("mean"))


def lag_correlation(spark, sf_dir):
    daily = tags(spark, sf_dir).withColumn("step", F.floor(F.unix_seconds("ts") / 3600)).groupBy("step").agg(F.sum(F.when(F.col("tag") % 2 == 0, F.col("value"))).alias("even"), F.sum(F.when(F.col("tag") % 2 == 1, F.col("value"))).alias("odd"))
    a, b = daily.select("step", F.col("even").alias("value")).filter("value is not null"), daily.select("step", F.col("odd").alias("value")).filter("value is not null")
    return series.lag_correlations(a, b, 6).select(F.col("lag").cast("long").alias("lag"), F.round("correlation", 6).alias("correlation"))


def ema_smooth(spark, sf_dir):
    return series.smoothed(tags(spark, sf_dir), 1 / 3).select("tag", "ts", F.round("smooth", 6).alias("smooth"))


QUERIES = {
    f.__name__: f
    for f in (tag_read_units, control_code_map, json_props_extract, classify_measurements, clean_range_delta, series_period, time_grid, interp_linear, interp_step, control_asof_step, asof_general, source_switch_edges, regime_hourly, sma_centered, lag_correlation, ema_smooth)
}

_POINTS_SQL = """
points AS (
  SELECT tag, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS t
  FROM (SELECT DISTINCT tag FROM tags), (SELECT date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM tags)),
p AS (SELECT points.tag, t, tags.ts AS pt, tags.value AS pv FROM points ASOF LEFT JOIN tags ON points.tag = tags.tag AND points.t >= tags.ts),
n AS (SELECT points.tag, t, tags.ts AS nt, tags.value AS nv FROM points ASOF LEFT JOIN tags ON points.tag = tags.tag AND points.t <= tags.ts)"""

ORACLES = {
    "tag_read_units": """
SELECT event_id, round(CASE event_type WHEN 'click' THEN value / 3600 WHEN 'error' THEN value / 1e-6 WHEN 'signup' THEN value + 273.15
  WHEN 'view' THEN value / (1 / 98067::DOUBLE) + 101325 ELSE value END, 6) AS si_value FROM events""",
    "control_code_map": "SELECT event_id, event_type <> 'purchase' AS is_opened FROM events WHERE event_type <> 'error'",
    "json_props_extract": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "classify_measurements": """
SELECT CASE WHEN event_type IN ('click', 'signup') THEN 'flow' ELSE 'endogenous' END AS kind, count(*) AS n, round(sum(value), 3) AS total
FROM events GROUP BY 1""",
    "clean_range_delta": f"""
WITH {TAGS_SQL}, w AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY tag ORDER BY ts)) AS change FROM tags WHERE value BETWEEN 5 AND 95)
SELECT tag, ts, value FROM w WHERE change IS NULL OR change <= 40""",
    "series_period": f"WITH {TAGS_SQL}, {PERIOD_SQL} SELECT t_start, t_end FROM period",
    "time_grid": f"""
WITH {TAGS_SQL}, {PERIOD_SQL}
SELECT row_number() OVER (ORDER BY t) - 1 AS step, t FROM (SELECT unnest(range(t_start, t_end, INTERVAL 1 HOUR)) AS t FROM period)""",
    "interp_linear": f"""
WITH {TAGS_SQL}, {_POINTS_SQL}
SELECT p.tag, p.t, round(CASE WHEN pt IS NULL OR nt IS NULL THEN NULL WHEN pt = nt THEN pv
  ELSE pv + (nv - pv) * ((epoch_us(p.t) - epoch_us(pt))::DOUBLE / (epoch_us(nt) - epoch_us(pt))::DOUBLE) END, 6) AS value
FROM p JOIN n ON p.tag = n.tag AND p.t = n.t""",
    "interp_step": f"""
WITH {TAGS_SQL}, {_POINTS_SQL}
SELECT p.tag, p.t, CASE WHEN nt IS NULL THEN NULL ELSE pv END AS value FROM p JOIN n ON p.tag = n.tag AND p.t = n.t""",
    "control_asof_step": f"""
WITH {TAGS_SQL}, g AS (SELECT date_trunc('hour', min(ts)) AS a FROM tags)
SELECT tag, ts, ((epoch_us(ts) - epoch_us(a)) // 900000000)::BIGINT AS step FROM tags, g""",
    "asof_general": """
WITH o AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT event_id, v.ts AS as_of_t, v.value FROM o ASOF LEFT JOIN v ON o.user_id = v.user_id AND o.ts >= v.ts""",
    "source_switch_edges": f"""
WITH {TAGS_SQL}, s AS (SELECT tag, ts, abs(value) < 25 AS is_zeroflow, lag(abs(value) < 25) OVER (PARTITION BY tag ORDER BY ts) AS was FROM tags)
SELECT tag, ts, is_zeroflow FROM s WHERE was IS NULL OR was <> is_zeroflow""",
    "regime_hourly": f"""
WITH {TAGS_SQL}, {PERIOD_SQL}, g AS (SELECT row_number() OVER (ORDER BY t) - 1 AS step, t FROM (SELECT unnest(range(t_start, t_end, INTERVAL 15 MINUTE)) AS t FROM period))
SELECT step, t FROM g WHERE step * 900 % 3600 = 0""",
    "sma_centered": f"""
WITH {TAGS_SQL}
SELECT tag, ts, round(CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END, 6) AS mean FROM tags
WINDOW w AS (PARTITION BY tag ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "lag_correlation": """
WITH d AS (
  SELECT epoch_us(ts) // 3600000000 AS step, sum(value) FILTER (user_id % 2 = 0) AS a, sum(value) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY 1)
SELECT lag::BIGINT AS lag, round(corr(x.a, y.b), 6) AS correlation
FROM d AS x, range(-6, 7) AS l(lag), d AS y WHERE y.step = x.step + lag AND x.a IS NOT NULL AND y.b IS NOT NULL GROUP BY lag""",
    "ema_smooth": f"""
WITH RECURSIVE {TAGS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ts) AS i FROM tags),
s AS (SELECT tag, ts, i, value AS smooth FROM r WHERE i = 1
      UNION ALL SELECT r.tag, r.ts, r.i, (1 / 3::DOUBLE) * r.value + (1 - 1 / 3::DOUBLE) * s.smooth FROM s JOIN r ON r.tag = s.tag AND r.i = s.i + 1)
SELECT tag, ts, round(smooth, 6) AS smooth FROM s""",
}
