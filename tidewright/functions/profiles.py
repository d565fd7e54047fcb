"""Profiles of pipes along their length, and piecewise characteristics of pumps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slopes of a head curve's straight continuations to the left and to the right.
LEFT_SLOPE, RIGHT_SLOPE = -0.005, -0.005 / 600


def subdivided(points: DataFrame, most: float, values: list[str]) -> DataFrame:
    """points(pipe, x, values) with points between, at equal distances and linear, so that none are further apart than most."""
    order = Window.partitionBy("pipe").orderBy("x")
    ahead = points.select("pipe", "x", *values, F.lead("x").over(order).alias("next_x"), *[F.lead(v).over(order).alias(f"next_{v}") for v in values])
    n = F.coalesce(F.greatest(F.lit(1), F.ceil((F.col("next_x") - F.col("x")) / most - 1e-8)), F.lit(1)).cast("int")
    parts = ahead.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    along = lambda c: F.coalesce(F.col(c) + (F.col(f"next_{c}") - F.col(c)) * F.col("i") / F.col("n"), F.col(c)).alias(c)
    return parts.select("pipe", along("x"), *[along(v) for v in values])


def decimated(exact: DataFrame, samples: DataFrame) -> DataFrame:
    """(pipe, sample, x): the first x of exact(pipe, x) at or after each sample of samples(pipe, sample), within 1e-8.

    A look-up ahead: both meet in one sort by pipe, from the end on, as a frame
    that runs to the end would be gone through anew for each row.
    """
    rows = exact.select("pipe", (F.col("x") + 1e-8).alias("at"), "x", F.lit(None).cast("double").alias("sample")).unionByName(samples.select("pipe", F.col("sample").alias("at"), F.lit(None).cast("double").alias("x"), "sample"))
    ahead = Window.partitionBy("pipe").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("x", F.last("x", ignorenulls=True).over(ahead)).filter("sample is not null").select("pipe", "sample", "x")


def uniform(points: DataFrame, least: float) -> DataFrame:
    """points(pipe, x, height, capacity) on equal steps of at least least metres.

    A point of the new grid takes the greatest height and the least capacity of
    the old points that are nearest to it; the ends keep their own values, and
    grid points without old ones near them are interpolated by subdivided().
    """
    dense = subdivided(points, least, ["height", "capacity"])
    size = points.groupBy("pipe").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    n = F.greatest(F.lit(1), F.floor((F.col("x1") - F.col("x0")) / least)).cast("int")
    grid = size.select("pipe", "x0", "x1", n.alias("n"), F.greatest(F.lit(least), (F.col("x1") - F.col("x0")) / n).alias("step"))
    placed = dense.join(grid, "pipe")
    raw = F.round((F.col("x") - F.col("x0")) / F.col("step")).cast("int")
    is_end = (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1"))
    index = F.when(F.col("x") == F.col("x0"), 0).when(F.col("x") == F.col("x1"), F.col("n")).otherwise(F.least(F.greatest(raw, F.least(F.lit(1), F.col("n"))), F.greatest(F.col("n") - 1, F.lit(0))))
    near = placed.withColumn("is_end", is_end).withColumn("point", index).groupBy("pipe", "point").agg(
        F.first("x0").alias("x0"), F.first("step").alias("step"), F.max("height").alias("height"), F.min("capacity").alias("capacity")
    )
    return near.select("pipe", F.col("point").cast("long").alias("point"), (F.col("x0") + F.col("point") * F.col("step")).alias("x"), "height", "capacity")


def head_curve(coefficients: list[float], low: float, high: float) -> list[tuple[float, float, list[float]]]:
    """(start, end, coefficients) of a cubic head curve between low and high, from its maximum on, with straight falling continuations."""
    if len(coefficients) != 4:
        raise ValueError("a head curve has four coefficients")
    c1, c2, c3 = coefficients[1], 2 * coefficients[2], 3 * coefficients[3]
    start, square = 0.0, c2 * c2 - 4 * c3 * c1
    if square >= 0 and c3 != 0:
        tops = [x for x in ((-c2 - math.sqrt(square)) / (2 * c3), (-c2 + math.sqrt(square)) / (2 * c3)) if c2 + 2 * c3 * x < 0]
        if not tops:
            raise ValueError("the head curve has no maximum")
        start = tops[0]
    start = max(start, low)
    at = lambda x: sum(c * x**i for i, c in enumerate(coefficients))
    line = lambda x, slope: [at(x) - slope * x, slope]
    return [(-math.inf, start, line(start, LEFT_SLOPE)), (start, high, list(coefficients)), (high, math.inf, line(high, RIGHT_SLOPE))]


def head_at(curve: list[tuple], flow: float, ratio: float = 1.0) -> float:
    """Head at a flow; ratio is the relative frequency, less what the wheel is reduced by."""
    x = flow / ratio
    for start, end, c in curve:
        if start <= x < end or (end == math.inf and x >= start):
            return ratio**2 * sum(a * x**i for i, a in enumerate(c))
    raise ValueError("the curve has a gap")


def flow_at(curve: list[tuple], head: float, ratio: float = 1.0) -> float:
    """The flow at which a falling curve has a head: the inverse of head_at."""
    h = head / ratio**2
    for start, end, c in curve:
        value = lambda x, c=c: sum(a * x**i for i, a in enumerate(c))
        if len(c) == 2:
            x = (h - c[0]) / c[1]
            if start <= x <= end:
                return x * ratio
        elif value(end) <= h <= value(start):
            a, b = start, end
            for _ in range(200):
                m = (a + b) / 2
                a, b = (m, b) if value(m) > h else (a, m)
            return (a + b) / 2 * ratio
    raise ValueError("no flow has this head")


def cubic_roots(a: float, b: float, c: float, d: float) -> list[float]:
    """Real roots of a x**3 + b x**2 + c x + d, in order, by trigonometry where there are three."""
    if a == 0:
        raise ValueError("not a cubic")
    p, q = (3 * a * c - b * b) / (3 * a * a), (2 * b**3 - 9 * a * b * c + 27 * a * a * d) / (27 * a**3)
    shift, bend = -b / (3 * a), (q / 2) ** 2 + (p / 3) ** 3
    if bend > 0:
        root = lambda v: math.copysign(abs(v) ** (1 / 3), v)
        return [root(-q / 2 + math.sqrt(bend)) + root(-q / 2 - math.sqrt(bend)) + shift]
    if p == 0:
        return [shift]
    angle = math.acos(max(-1.0, min(1.0, 3 * q / (2 * p) * math.sqrt(-3 / p)))) / 3
    return sorted(2 * math.sqrt(-p / 3) * math.cos(angle - 2 * math.pi * k / 3) + shift for k in range(3))
