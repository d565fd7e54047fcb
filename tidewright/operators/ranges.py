"""Look-ups in tables of ranges, both sides of any size, as equality joins on cells of several widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells of one level are so many times as wide as those of the level below; a range takes the widest cells that aren't wider than itself, so it lies in at most BASE + 1 of them.
BASE = 8.0


def _axis(df: DataFrame, name: str) -> Column:
    """A column as a double that keeps its order."""
    kind, c = df.schema[name].dataType.simpleString(), F.col(name)
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def containing(points: DataFrame, ranges: DataFrame, x: str, low: str, high: str, keys: list[str] | None = None) -> DataFrame:
    """points joined with each of ranges (of equal keys) that holds x: low included, high excluded.

    Columns are those of points and those of ranges but keys; other names must
    differ. Null or NaN places and bounds, and empty ranges, meet nothing;
    infinite bounds are open ends. A range is listed under the cells of its
    level that it touches, a point under one cell of each level that occurs, so
    a pair meets once, and at least about half of those that meet are pairs.
    Nothing is broadcast by hand: cells are sort-merge keys that AQE can split.
    The driver sees the points' bounds and the levels, of which doubles have
    at most about 700.
    """
    keys = keys or []
    at = points.withColumn("__x", _axis(points, x)).filter("__x is not null and not isnan(__x)")
    finite = F.abs("__x") < float("inf")
    found = at.agg(F.min(F.when(finite, F.col("__x"))).alias("a"), F.max(F.when(finite, F.col("__x"))).alias("b")).first()
    least, most = (found["a"], found["b"]) if found["a"] is not None else (0.0, 0.0)

    spans = ranges.withColumn("__low", _axis(ranges, low)).withColumn("__high", _axis(ranges, high))
    spans = spans.filter(F.col("__low").isNotNull() & F.col("__high").isNotNull() & ~F.isnan("__low") & ~F.isnan("__high") & (F.col(low) < F.col(high)))
    # what is infinite lies in the outermost cells of points
    inside = lambda c: F.greatest(F.least(c, F.lit(most)), F.lit(least))
    spans = spans.withColumn("__a", inside(F.col("__low"))).withColumn("__b", inside(F.col("__high")))
    width = F.greatest(F.col("__b") - F.col("__a"), F.greatest(F.abs("__a"), F.abs("__b")) * 2.0**-48, F.lit(1e-290))
    spans = spans.withColumn("__level", F.floor(F.log(BASE, width)).cast("int"))
    levels = sorted(r["__level"] for r in spans.select("__level").distinct().collect())

    size = F.pow(F.lit(BASE), F.col("__level"))
    cells = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__a") / size), F.floor(F.col("__b") / size)))).drop("__low", "__high", "__a", "__b")
    listed = F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))
    dealt = at.withColumn("__level", listed).withColumn("__cell", F.floor(inside(F.col("__x")) / size)).drop("__x")
    met = dealt.join(cells, [*keys, "__level", "__cell"]).filter((F.col(x) >= F.col(low)) & (F.col(x) < F.col(high)))
    return met.select(*points.columns, *[c for c in ranges.columns if c not in keys])


def successive(rows: DataFrame, place: str, keys: list[str], slice_width: float) -> DataFrame:
    """rows with until: the next greater place of the same keys, infinity at the last; so distinct places are ranges that leave nothing out between them.

    Rows are dealt by slices of the axis, and a slice's last place has its
    successor from one row for each slice, so one key may hold any share of
    the rows. Null and NaN places are left out.
    """
    known = rows.filter(F.col(place).isNotNull() & ~F.isnan(F.col(place).cast("double"))).withColumn("__slice", F.floor(F.col(place) / slice_width))
    distinct = known.select(*keys, "__slice", place).distinct()
    within = Window.partitionBy(*keys, "__slice").orderBy(place)
    over = Window.partitionBy(*keys).orderBy("__slice")
    firsts = distinct.groupBy(*keys, "__slice").agg(F.min(place).alias("__first")).withColumn("__coming", F.lead("__first").over(over)).drop("__first")
    ends = distinct.withColumn("__own", F.lead(place).over(within)).join(firsts, [*keys, "__slice"])
    until = F.coalesce(F.col("__own").cast("double"), F.col("__coming").cast("double"), F.lit(float("inf"))).alias("until")
    return known.drop("__slice").join(ends.select(*keys, place, until), [*keys, place])
