"""Scalar laws, polynomials, viscosity, heat and text on columns of the test tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions import heat, scalar, units
from tidewright.plans.tables import table


def _lines(spark, sf_dir):
    """x from -4000 to 96000, q from 1 to 50, d from 0 to 0.1."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - 4000).alias("x"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))


def _rounded(rows, digits: int = 6, **columns):
    return rows.select("l_orderkey", "l_linenumber", *[F.round(c, digits).alias(n) for n, c in columns.items()])


def signed_powers(spark, sf_dir):
    """Signs, roots and squares that keep the sign."""
    rows = _lines(spark, sf_dir)
    return _rounded(rows, sgn=scalar.sgn("x"), pseudo=scalar.pseudo_sgn("x"), root=scalar.ssqrt("x"), square=scalar.ssqr(F.col("x") / 1000), plain=scalar.sqr("q"), area=scalar.circle_area("q"))


def finite_values(spark, sf_dir):
    """Quotients that may be infinite or not a number, and whether there are any in an order."""
    rows = _lines(spark, sf_dir).withColumn("quotient", F.when(F.col("d") == 0, F.lit(float("inf"))).when(F.col("t") == 0, F.lit(float("nan"))).otherwise(F.col("q") / F.col("d")))
    return rows.groupBy("l_orderkey").agg(F.count_if(scalar.is_finite("quotient")).alias("n_finite"), F.bool_or(~scalar.is_finite("quotient")).alias("has_not_finite"))


def range_lookup(spark, sf_dir):
    """The first range whose end is above a quantity, whether it is between two others in either order, and a value between two."""
    ends = F.array(*[F.lit(x) for x in (5.0, 10.0, 20.0, 45.0)])
    rows = _lines(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", scalar.range_index(ends, "q").cast("long").alias("piece"), scalar.in_range("q", 40.0, 12.0).alias("within"), F.round(scalar.lerp("q", "x", "d"), 6).alias("between"))


def products_and_norms(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    a, b = F.array("q", "d", "t"), F.array("d", "q", F.lit(2.0))
    return _rounded(rows, product=scalar.inner_product(a, b), increment=scalar.argument_increment(a, F.array("x", "q", "d")))


def small_weights(spark, sf_dir):
    """Weights near zero are moved off it by a hundred millionth."""
    rows = _lines(spark, sf_dir).withColumn("w", (F.col("d") - 0.05) * 1e-7)
    return rows.select("l_orderkey", "l_linenumber", F.round(scalar.fix_small("w") * 1e10, 2).alias("weight"))


def friction_laws(spark, sf_dir):
    """Friction over roughness, effectiveness of additives, mixing in a pipe."""
    rows = _lines(spark, sf_dir)
    return _rounded(
        rows,
        shifrinson=scalar.friction_shifrinson(F.col("d") / 10 + 1e-4),
        polynomial=scalar.drag_reduction("polynomial", [0.01, 0.02, -1e-4], "q"),
        virk=scalar.drag_reduction("virk", [0.8, 0.05], "q"),
        modified=scalar.drag_reduction("virk_modified", [20.0, 1.25], "q"),
        potential=scalar.drag_reduction("potential", [0.1, 0.5], "q"),
        mixing=scalar.diffusion_coefficient(0.02, "q", 0.7),
    )


def elastic_laws(spark, sf_dir):
    """Density under pressure, what walls give way, and the speed of sound."""
    rows = _lines(spark, sf_dir)
    wall = scalar.wall_compression(0.7, 0.3, 2e11, F.col("q") / 1000)
    return _rounded(rows, 4, density=scalar.density_at(850.0, 7e-10, F.col("x") * 100, 101325.0), wall=wall * 1e12, sound=scalar.sound_velocity(850.0, wall, 7e-10))


def viscosity_laws(spark, sf_dir):
    """The coefficient through two points, the three kinds of curves, and a table scaled to a working point."""
    rows = table(spark, sf_dir, "events").select("event_id", (273.15 + F.col("value") / 2).alias("t"))
    curve = lambda a, b, c: scalar.viscosity_of(scalar.viscosity_model(F.lit(a), F.lit(b), F.lit(c)), "t")
    adapted = scalar.viscosity_adapted(F.array(F.lit(30.0), F.lit(12.0), F.lit(5.0)), F.lit(14.0), "t")
    return rows.select(
        "event_id",
        F.round(scalar.viscosity_coefficient(F.col("t"), 293.15, 5.0, 323.15), 6).alias("coefficient"),
        F.round(curve(8.0, 8.0, 8.0), 6).alias("constant"),
        F.round(curve(16.0 * math.e, 16.0, 16.0 * math.exp(-1.5)), 6).alias("filonov"),
        F.round(adapted[0], 6).alias("at_0"),
        F.round(adapted[2], 6).alias("at_50"),
    )


def heat_laws(spark, sf_dir):
    """Passage to the temperature of the surroundings, layers of insulation, soil and fluid after a step."""
    rows = _lines(spark, sf_dir).withColumn("w", F.col("q") * 10)
    return _rounded(
        rows,
        4,
        shukhov=scalar.shukhov_temperature(320.0, 280.0, 2.0, 0.7, 2000.0, "w", 10_000.0),
        with_friction=heat.shukhov(320.0, 280.0, "w", 850.0, 2000.0, 0.7, 1e-4, 2.0, 10_000.0),
        lift=heat.friction_heating("w", 850.0, 0.7, 1e-4, 2.0),
        layer=heat.layer_transfer(0.7, F.col("d") / 10 + 0.01, 0.04),
        conducted=heat.conducted(F.col("q") + 290, 280.0, 0.7, 0.05, 0.04),
        radiated=heat.radiated(F.col("q") + 290, 280.0, 0.7, 0.05),
        both=heat.conducted_and_radiated(F.col("q") + 290, 280.0, 0.7, 0.05, 0.04),
        soil_flow=heat.soil_flow(F.col("q") + 290, 285.0, 280.0, -2.0, 0.5, 0.1, -0.2),
        soil=heat.soil_step(F.col("q") + 290, 285.0, 280.0, 1e-6, -2e-6, 3600.0),
        fluid=heat.fluid_step(F.col("q") + 290, -20.0, "w", 850.0, 2000.0, 0.7, 1e-4, 60.0),
        diffusivity=scalar.thermal_diffusivity(F.col("q"), 1500.0, 0.8),
    )


def displacement_times(spark, sf_dir):
    """Seconds in which a flow replaces what a pipe holds, and the step of a Courant number of 1."""
    rows = _lines(spark, sf_dir)
    return _rounded(rows, 3, whole=scalar.displacement_time(5000.0, 0.7, F.col("q") / 50), cell=scalar.displacement_time(200.0, 0.7, F.col("q") / 50))


def quantity_names(spark, sf_dir):
    """Names of quantities as objects have them: which side, which quantity, whether it is a flow; flags as text."""
    keys = F.array(*[F.lit(k) for k in ("density_std_in", "vol_flow_std", "temperature_out", "mass_flow_in", "pressure", "viscosity_working_out", "sulfur")])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.get(keys, F.col("p_partkey") % 7)).alias("key"), F.col("p_size"))
    mtype, side = units.quantity_and_side(F.col("key"))
    flag = F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.col("p_size") % 3 == 1)
    return rows.select("p_partkey", mtype.alias("mtype"), side.alias("side"), units.is_flow(mtype).alias("is_flow"), units.is_endogenous(mtype).alias("is_endogenous"), scalar.flag_text(flag).alias("flag"), F.replace("key", F.lit("_"), F.lit(" ")).alias("spaced"))


def profile_slopes(spark, sf_dir):
    """A user's events as points of a pipe: the slope to the next point (the last one's is that before), and the whole length."""
    order = Window.partitionBy("pipe").orderBy("nth")
    points = table(spark, sf_dir, "events").select(F.col("user_id").alias("pipe"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).alias("nth"), "value")
    points = points.withColumn("x", F.col("nth") * 100.0)
    ahead = (F.lead("value").over(order) - F.col("value")) / (F.lead("x").over(order) - F.col("x"))
    behind = (F.col("value") - F.lag("value").over(order)) / (F.col("x") - F.lag("x").over(order))
    whole = Window.partitionBy("pipe")
    return points.select("pipe", "nth", F.round(F.coalesce(ahead, behind), 8).alias("slope"), F.round(F.max("x").over(whole) - F.min("x").over(whole), 3).alias("length"))


QUERIES = {f.__name__: f for f in (signed_powers, finite_values, range_lookup, products_and_norms, small_weights, friction_laws, elastic_laws, viscosity_laws, heat_laws, displacement_times, quantity_names, profile_slopes)}

_LINES = "r AS (SELECT l_orderkey, l_linenumber, l_extendedprice - 4000 AS x, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem)"
_KEY = "k AS (SELECT l_orderkey, l_linenumber FROM lineitem)"
_AREA = f"({math.pi}::DOUBLE * 0.7::DOUBLE * 0.7::DOUBLE / 4)"

ORACLES = {
    "signed_powers": f"""
WITH {_LINES} SELECT l_orderkey, l_linenumber, round(sign(x)::DOUBLE, 6) AS sgn, CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS pseudo, round(sign(x) * sqrt(abs(x)), 6) AS root,
 round(sign(x) * (x / 1000) * (x / 1000), 6) AS square, round(q * q, 6) AS plain, round({math.pi}::DOUBLE * q * q / 4, 6) AS area FROM r""",
    "finite_values": f"""
WITH {_LINES} SELECT l_orderkey, count(*) FILTER (d <> 0 AND t <> 0) AS n_finite, count(*) FILTER (d = 0 OR t = 0) > 0 AS has_not_finite FROM r GROUP BY 1""",
    "range_lookup": f"""
WITH {_LINES} SELECT l_orderkey, l_linenumber, CASE WHEN q < 5 THEN 0 WHEN q < 10 THEN 1 WHEN q < 20 THEN 2 WHEN q < 45 THEN 3 END::BIGINT AS piece, q BETWEEN 12 AND 40 AS within,
 round(q * (1 - d) + x * d, 6) AS between FROM r""",
    "products_and_norms": f"""
WITH {_LINES}, s AS (SELECT *, q / greatest(1, abs(x)) AS a, d / greatest(1, abs(q)) AS b, t / greatest(1, abs(d)) AS c FROM r)
SELECT l_orderkey, l_linenumber, round(q * d + d * q + t * 2, 6) AS product, round(sqrt(a * a + b * b + c * c) / 3, 6) AS increment FROM s""",
    "small_weights": f"""
WITH {_LINES}, s AS (SELECT *, (d - 0.05::DOUBLE) * 1e-7::DOUBLE AS w FROM r)
SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(w) < 1e-8::DOUBLE THEN w + (CASE WHEN w >= 0 THEN 1 ELSE -1 END) * 1e-8::DOUBLE ELSE w END * 1e10, 2) AS weight FROM s""",
    "friction_laws": f"""
WITH {_LINES} SELECT l_orderkey, l_linenumber, round(0.11::DOUBLE * pow(d / 10 + 1e-4::DOUBLE, 0.25), 6) AS shifrinson,
 round(0.01::DOUBLE + q * (0.02::DOUBLE + q * -1e-4::DOUBLE), 6) AS polynomial, round(0.8::DOUBLE * (0.05::DOUBLE * q) / (1 + 0.05::DOUBLE * q), 6) AS virk,
 round(q / (20 + 1.25::DOUBLE * q), 6) AS modified, round(0.1::DOUBLE * pow(q, 0.5), 6) AS potential, round(3.211::DOUBLE * sqrt(0.02::DOUBLE) * q * 0.7::DOUBLE, 6) AS mixing FROM r""",
    "elastic_laws": f"""
WITH {_LINES}, s AS (SELECT *, 0.7::DOUBLE * (1 - 0.3::DOUBLE * 0.3::DOUBLE) / (2e11::DOUBLE * (q / 1000)) AS wall FROM r)
SELECT l_orderkey, l_linenumber, round(850 * (1 + 7e-10::DOUBLE * (x * 100 - 101325)), 4) AS density, round(wall * 1e12, 4) AS wall, round(sqrt(1 / (850 * (wall + 7e-10::DOUBLE))), 4) AS sound FROM s""",
    "viscosity_laws": """
WITH r AS (SELECT event_id, 273.15::DOUBLE + value / 2 AS t FROM events),
c AS (SELECT ln(30.0::DOUBLE / 12) AS f1, ln(12.0::DOUBLE / 5) AS f2),
k AS (SELECT *, 1.5::DOUBLE * f1 / f2 AS bend FROM c),
m AS (SELECT *, (323.15::DOUBLE - bend * 273.15::DOUBLE) / (1 - bend) AS theta FROM k),
v AS (SELECT event_id, t, 14 / (5 * pow(5.0::DOUBLE / 30, 1 / (bend - 1)) * exp((273.15::DOUBLE - theta) * (293.15::DOUBLE - theta) / 20 * f1 / (t - theta))) AS f FROM r, m)
SELECT event_id, round(ln(t / 5) / (323.15::DOUBLE - 293.15::DOUBLE), 6) AS coefficient, 8.0::DOUBLE AS constant,
 round(16 * exp(-0.05::DOUBLE * (t - 293.15::DOUBLE)), 6) AS filonov, round(30 * f, 6) AS at_0, round(5 * f, 6) AS at_50 FROM v""",
    "heat_laws": f"""
WITH {_LINES}, s AS (SELECT *, q * 10 AS w, 0.11::DOUBLE * pow(1e-4::DOUBLE, 0.25) AS lam, (q * 10) / ({_AREA} * 850) AS v, q + 290 AS f FROM r),
h AS (SELECT *, lam * 850 * pow(abs(v), 3) / (8 * 2.0::DOUBLE) AS lift, 0.7::DOUBLE / (0.7::DOUBLE + 2 * 0.05::DOUBLE) AS ratio, 2 * 0.04::DOUBLE / (0.7::DOUBLE * ln((0.7::DOUBLE + 2 * 0.05::DOUBLE) / 0.7::DOUBLE)) AS k FROM s),
g AS (SELECT *, -k * (f - 280) AS cond, -(1 / (1 / 0.075::DOUBLE + ratio * (1 / 0.075::DOUBLE - 1))) * 5.76e-8::DOUBLE * (pow(f, 4) - pow(280.0::DOUBLE, 4)) AS rad FROM h)
SELECT l_orderkey, l_linenumber, round(280 + 40 * exp(-{math.pi}::DOUBLE * 2 * 0.7::DOUBLE * 10000 / (2000 * abs(w))), 4) AS shukhov,
 round(280 + lift + (320 - (280 + lift)) * exp(-{math.pi}::DOUBLE * 0.7::DOUBLE * 2 * 10000 / (2000 * abs(w))), 4) AS with_friction, round(lift, 4) AS lift,
 round(2 * 0.04::DOUBLE / (0.7::DOUBLE * ln((0.7::DOUBLE + 2 * (d / 10 + 0.01::DOUBLE)) / 0.7::DOUBLE)), 4) AS layer, round(cond, 4) AS conducted, round(rad, 4) AS radiated,
 round(cond * 0.04::DOUBLE + rad * (1 - 0.04::DOUBLE), 4) AS both, round((-2 + 0.5::DOUBLE * 0.1::DOUBLE) * (f - 280) + -0.2::DOUBLE * 0.5::DOUBLE * (285 - 280), 4) AS soil_flow,
 round(285 + 3600 * (1e-6::DOUBLE * (f - 280) + -2e-6::DOUBLE * (285 - 280)), 4) AS soil,
 round(f + 60 * (4 * -20.0::DOUBLE / (850 * 2000 * 0.7::DOUBLE) + lam * pow(v, 3) / (2 * 2000 * 0.7::DOUBLE)), 4) AS fluid, round(q / (1500 * 0.8::DOUBLE), 4) AS diffusivity FROM g""",
    "displacement_times": f"""
WITH {_LINES} SELECT l_orderkey, l_linenumber, round(5000 * {_AREA} / (q / 50), 3) AS whole, round(200 * {_AREA} / (q / 50), 3) AS cell FROM r""",
    "quantity_names": """
WITH k AS (SELECT p_partkey, p_size, list_extract(['density_std_in', 'vol_flow_std', 'temperature_out', 'mass_flow_in', 'pressure', 'viscosity_working_out', 'sulfur'], (p_partkey % 7 + 1)::INTEGER) AS key FROM part),
m AS (SELECT *, regexp_replace(key, '_(in|out)$', '') AS mtype FROM k)
SELECT p_partkey, mtype, CASE WHEN key LIKE '%\\_in' ESCAPE '\\' THEN 'Inlet' WHEN key LIKE '%\\_out' ESCAPE '\\' THEN 'Outlet' END AS side,
 mtype IN ('mass_flow', 'vol_flow_std', 'vol_flow_working') AS is_flow, mtype NOT IN ('mass_flow', 'vol_flow_std', 'vol_flow_working') AS is_endogenous,
 CASE p_size % 3 WHEN 0 THEN 'undefined' WHEN 1 THEN 'true' ELSE 'false' END AS flag, replace(key, '_', ' ') AS spaced FROM m""",
    "profile_slopes": """
WITH p AS (SELECT user_id AS pipe, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS nth, value FROM events),
s AS (SELECT *, lead(value) OVER w AS after, lag(value) OVER w AS before, count(*) OVER (PARTITION BY pipe) AS n FROM p WINDOW w AS (PARTITION BY pipe ORDER BY nth))
SELECT pipe, nth, round(coalesce((after - value) / 100, (value - before) / 100), 8) AS slope, round((n - 1) * 100.0::DOUBLE, 3) AS length FROM s""",
}
