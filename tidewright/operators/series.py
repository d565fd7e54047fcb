"""Time-series operators on long tables tags(tag, ts, value).

Look-ups by time are unions with windows, never inequality joins: both sides
meet in one shuffle by tag. Where one tag may hold a large share of all rows,
the windows are cut into slices of time first (see around()).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups that smoothed() looks back over: AHEAD - 1 of them hold so many rows that a value's factor is below the least double.
AHEAD = 4


def period(tags: DataFrame) -> DataFrame:
    """(t_start, t_end): the time that all tags cover; null values don't count.

    Raises if the tags have no time in common. The inner aggregate combines on
    the map side, so a hot tag shuffles a row for each task.
    """
    each = tags.filter("value is not null").groupBy("tag").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return each.agg(F.max("first").alias("t_start"), F.min("last").alias("t_end")).filter(
        F.when(F.col("t_start") > F.col("t_end"), F.raise_error(F.lit("the tags have no time in common")).cast("boolean")).otherwise(F.lit(True))
    )


def grid(bounds: DataFrame, step_seconds: int) -> DataFrame:
    """(step, t) from t_start on, every step_seconds, t_end exclusive.

    The two bounds come to the driver, so that the steps are a range that is
    dealt over tasks, however many there are.
    """
    kind = bounds.schema["t_start"].dataType
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    row = bounds.select(micros("t_start").alias("a"), micros("t_end").alias("b")).first()
    spark = bounds.sparkSession
    n = 0 if row is None or row["a"] is None or row["b"] is None else max(0, -(-(row["b"] - row["a"]) // (step_seconds * 1_000_000)))
    start = F.lit(row["a"] if n else 0)
    return spark.range(n).select(F.col("id").alias("step"), F.timestamp_micros(start + F.col("id") * step_seconds * 1_000_000).cast(kind).alias("t"))


def around(points: DataFrame, tags: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """points(tag, t, ...) with the readings before (prev_t, prev_v) and after (next_t, next_v), each at t itself if there is one.

    Rows are dealt by tag and slice of time, so that a tag of any size is many
    keys. What a slice needs from its neighbours, the last reading before and
    the first after it, is found from one row for each slice and handed to it.
    What comes after is looked up backwards in time: a frame that runs to the
    end is gone through anew for each row, one that runs from the start is not.
    """
    extra = [c for c in points.columns if c not in ("tag", "t")]
    slice_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / slice_seconds)
    seen = tags.filter("value is not null").select("tag", F.col("ts").alias("t"), "value", slice_of("ts").alias("slice"))
    ends = seen.groupBy("tag", "slice").agg(F.max_by(F.struct("t", "value"), "t").alias("last"), F.min_by(F.struct("t", "value"), "t").alias("first"))
    asked = points.select("tag", slice_of("t").alias("slice")).distinct()
    order = Window.partitionBy("tag").orderBy("slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("tag").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    handed = (
        ends.join(asked, ["tag", "slice"], "full")
        .select("tag", "slice", F.last("last", ignorenulls=True).over(before).alias("carried"), F.last("first", ignorenulls=True).over(after).alias("coming"))
    )
    rows = (
        points.select("tag", "t", slice_of("t").alias("slice"), F.lit(None).cast("double").alias("value"), F.struct(*(extra or ["tag"])).alias("own"), F.lit(True).alias("asked"))
        .unionByName(seen.select("tag", "t", "slice", "value", F.lit(None).alias("own"), F.lit(False).alias("asked")))
    )
    here = Window.partitionBy("tag", "slice").orderBy("t")
    back = here.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("tag", "slice").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reading = F.when(~F.col("asked"), F.struct("t", "value"))
    looked = rows.withColumn("p", F.last(reading, ignorenulls=True).over(back)).withColumn("n", F.last(reading, ignorenulls=True).over(ahead)).filter("asked")
    joined = looked.join(handed, ["tag", "slice"], "left")
    p, n = F.coalesce("p", "carried"), F.coalesce("n", "coming")
    return joined.select(
        "tag", "t", *[F.col("own")[c].alias(c) for c in extra], p["t"].alias("prev_t"), p["value"].alias("prev_v"), n["t"].alias("next_t"), n["value"].alias("next_v")
    )


def interpolated(points: DataFrame, tags: DataFrame, mode: str = "linear") -> DataFrame:
    """points with value at t: exact, else linear between neighbours or (mode step) the one before; null outside a tag's time."""
    found = around(points, tags)
    outside = F.col("prev_t").isNull() | F.col("next_t").isNull()
    if mode == "step":
        value = F.when(~outside, F.col("prev_v"))
    elif mode == "linear":
        seconds = lambda a, b: (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))).cast("double")
        share = seconds("prev_t", "t") / seconds("prev_t", "next_t")
        value = F.when(outside, None).when(F.col("prev_t") == F.col("next_t"), F.col("prev_v")).otherwise(F.col("prev_v") + (F.col("next_v") - F.col("prev_v")) * share)
    else:
        raise ValueError(f"unknown mode {mode}")
    return found.withColumn("value", value).drop("prev_t", "prev_v", "next_t", "next_v")


def as_of(points: DataFrame, tags: DataFrame) -> DataFrame:
    """points with the time and value of the last reading at or before t; null if there is none."""
    return around(points, tags).drop("next_t", "next_v").withColumnRenamed("prev_t", "as_of_t").withColumnRenamed("prev_v", "value")


def grid_step(ts: Column, start: Column, step_seconds: int) -> Column:
    """Number of the last grid time at or before ts: an as-of join on an even grid."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / (step_seconds * 1_000_000)).cast("long")


def _slice(seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds)


def preceded(rows: DataFrame, value: str, name: str, slice_seconds: int = 86_400) -> DataFrame:
    """rows(tag, ts, ...) with what value was at the tag's row before, as name; null at its first.

    Rows are dealt by tag and slice of time; a slice's first row has it from
    one row for each slice, so a tag of any size is many tasks' work. Rows of
    one time come in order of value.
    """
    sliced = rows.withColumn("slice", _slice(slice_seconds))
    here = Window.partitionBy("tag", "slice").orderBy("ts", value)
    ends = sliced.groupBy("tag", "slice").agg(F.max_by(value, F.struct("ts", value)).alias("last"))
    carried = ends.select("tag", "slice", F.lag("last").over(Window.partitionBy("tag").orderBy("slice")).alias("carried"))
    placed = sliced.withColumn("own", F.lag(value).over(here)).withColumn("nth", F.row_number().over(here))
    return placed.join(carried, ["tag", "slice"]).withColumn(name, F.when(F.col("nth") == 1, F.col("carried")).otherwise(F.col("own"))).select(*rows.columns, name)


def numbered(rows: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """rows(tag, ts, ...) with nth: their numbers within the tag, from 0 in order of ts, by slices of time; rows of one time in order of a hash of all they hold."""
    sliced = rows.withColumn("slice", _slice(slice_seconds))
    so_far = Window.partitionBy("tag").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy("tag", "slice").agg(F.count(F.lit(1)).alias("n")).select("tag", "slice", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    placed = sliced.withColumn("nth", F.row_number().over(Window.partitionBy("tag", "slice").orderBy("ts", F.xxhash64(*rows.columns))) - 1)
    return placed.join(counts, ["tag", "slice"]).withColumn("nth", F.col("nth") + F.col("before")).select(*rows.columns, "nth")


def cleaned(tags: DataFrame, low: float, high: float, most_change: float) -> DataFrame:
    """Readings within [low, high] that are at most most_change from the one before within that range."""
    within = tags.filter(F.col("value").between(low, high) & ~F.isnan("value"))
    change = F.abs(F.col("value") - F.col("before"))
    return preceded(within, "value", "before").filter(F.col("before").isNull() | (change <= most_change)).drop("before")


def switchings(tags: DataFrame, threshold: float) -> DataFrame:
    """(tag, ts, is_zeroflow) where a flow comes to rest or sets off, its first state included."""
    state = tags.select("tag", "ts", (F.abs("value") < threshold).alias("is_zeroflow"))
    return preceded(state, "is_zeroflow", "was").filter("was is null or was <> is_zeroflow").drop("was")


def regimes(steps: DataFrame, step_seconds: int, every_seconds: int = 3600) -> DataFrame:
    """Steps whose model time is a multiple of every_seconds, within a ten-thousandth of a second."""
    return steps.filter(F.pmod(F.col("step") * F.lit(float(step_seconds)), F.lit(float(every_seconds))) < 1e-4)


def centred_mean(tags: DataFrame, width: int, piece: int = 100_000) -> DataFrame:
    """tags with mean: that of width (odd) readings around each; null where the window isn't full.

    A tag's readings are numbered and dealt in pieces; those next to a piece's
    ends are copied to its neighbour, which needs them for its windows.
    """
    half = width // 2
    if piece <= width:
        raise ValueError("a piece must be larger than a window")
    own = F.floor(F.col("nth") / piece)
    near = F.array_distinct(F.array(own, F.floor((F.col("nth") - half) / piece), F.floor((F.col("nth") + half) / piece)))
    dealt = numbered(tags).withColumn("own", own).withColumn("piece", F.explode(near))
    frame = Window.partitionBy("tag", "piece").orderBy("nth").rowsBetween(-half, half)
    mean = F.when(F.count("value").over(frame) == 2 * half + 1, F.avg("value").over(frame))
    return dealt.withColumn("mean", mean).filter("own = piece").select(*tags.columns, "mean")


def smoothed(tags: DataFrame, alpha: float, slice_seconds: int = 86_400) -> DataFrame:
    """(tag, ts, value, smooth) with smooth = alpha * value + (1 - alpha) * smooth before, from the first value on.

    The recurrence is linear, so each stretch of rows is an affine map of what
    it begins with, and maps compose in three tiers of running sums: rows
    within a part of a slice of time, parts (one row each) within a group, and
    groups. What is left of a value halves on and on: beyond AHEAD groups its
    factor is zero in double precision, so a group asks only so many before it.
    No tag is one row or one list, and the work is linear in its readings. Null
    values are left out, ties in ts are taken in order of value.
    """
    if alpha >= 1:
        return tags.filter("value is not null").select("tag", "ts", "value", F.col("value").alias("smooth"))
    keep = 1.0 - alpha
    reach = max(1, int(min(1 << 60, 250 / -math.log(keep)))) if keep < 1 else 1 << 60
    longest = min(100_000, reach)
    power = lambda n: F.pow(F.lit(keep), n)
    placed = (
        tags.filter("value is not null").select("tag", "ts", "value", _slice(slice_seconds).alias("slice"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("tag", "slice").orderBy("ts", "value")) - 1)
        .withColumn("part", F.floor(F.col("nth") / longest)).withColumn("place", F.col("nth") % longest + 1)
    )
    so_far = Window.partitionBy("tag", "slice", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alone = placed.withColumn("own", alpha * power(F.col("place")) * F.sum(F.col("value") * power(-F.col("place"))).over(so_far))
    parts = alone.groupBy("tag", "slice", "part").agg(F.count(F.lit(1)).alias("n"), F.max_by("own", "place").alias("end"), F.min_by("value", "place").alias("first"))

    by_part = Window.partitionBy("tag").orderBy("slice", "part").rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.withColumn("before", F.coalesce(F.sum("n").over(by_part), F.lit(0))).withColumn("group", F.floor(F.col("before") / reach))
    in_group = Window.partitionBy("tag", "group")
    passed = in_group.orderBy("slice", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = counted.withColumn("done", F.sum("n").over(passed)).withColumn("sum", F.sum(F.col("end") * power(-F.col("done"))).over(passed) * power(F.col("done")))
    before_it = in_group.orderBy("slice", "part")
    ended = ended.withColumn("had", F.coalesce(F.lag("sum").over(before_it), F.lit(0.0))).withColumn("rows", F.col("done") - F.col("n"))
    groups = ended.groupBy("tag", "group").agg(F.max("done").alias("n"), F.max_by("sum", "done").alias("end"), F.min_by("first", "done").alias("first"))
    by_group = Window.partitionBy("tag").orderBy("group")
    origin = F.first("first").over(by_group.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = origin
    for k in range(AHEAD, 0, -1):
        lagged = F.lag(F.struct("end", "n"), k).over(by_group)
        start = F.when(lagged.isNull(), origin).otherwise(lagged["end"] + power(lagged["n"]) * start)
    started = groups.select("tag", "group", start.alias("start"))
    carried = ended.join(started, ["tag", "group"]).select("tag", "slice", "part", (F.col("had") + power(F.col("rows")) * F.col("start")).alias("carried"))
    return alone.join(carried, ["tag", "slice", "part"]).select("tag", "ts", "value", (F.col("own") + power(F.col("place")) * F.col("carried")).alias("smooth"))


def _block_sums(most_lag: int, block: int):
    """For one block of steps, the sums at each lag, by Fourier transforms of what both sides hold."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        base = int(rows["block"].iloc[0]) * block
        size = 1 << (2 * block + 2 * most_lag - 1).bit_length()

        def spectra(side: int, begin: int) -> list[np.ndarray]:
            mine = rows[rows["side"] == side]
            out = []
            for column in ("n", "x", "xx"):
                filled = np.zeros(size)
                filled[mine["step"].to_numpy() - begin] = mine[column].to_numpy(float)
                out.append(np.fft.rfft(filled))
            return out

        if rows["side"].nunique() < 2:
            return pd.DataFrame({c: [] for c in ("lag", "n", "x", "y", "xx", "yy", "xy")})
        a, b = spectra(0, base), spectra(1, base - most_lag)
        met = lambda i, j: np.fft.irfft(np.conj(a[i]) * b[j], size)[: 2 * most_lag + 1]
        return pd.DataFrame(
            {"lag": np.arange(-most_lag, most_lag + 1), "n": np.rint(met(0, 0)), "x": met(1, 0), "y": met(0, 1), "xx": met(2, 0), "yy": met(0, 2), "xy": met(1, 1)}
        )

    return one


def lag_correlations(a: DataFrame, b: DataFrame, most_lag: int) -> DataFrame:
    """(lag, correlation) of steps(step, value) a and b shifted by up to most_lag steps either way: a at a step with b at step + lag.

    Steps are cut into blocks of at least 2 * most_lag; a row of b goes to the
    one or two blocks whose windows reach it, so what is shuffled doesn't grow
    with the number of lags. A block's sums over all lags are products of
    Fourier transforms of counts, values and squares, taken from the means for
    precision. Steps may lack on either side, and a step that a side holds
    several times counts with each of its rows; null and non-finite values are
    left out. Lags at which no two rows meet have no row, and those at which
    one side doesn't vary have a null correlation.
    """
    block = max(4096, 2 * most_lag)
    known = lambda rows: rows.select("step", F.col("value").cast("double").alias("value")).filter("value is not null and not isnan(value) and abs(value) < double('Infinity')")

    def steps(rows: DataFrame, side: int) -> DataFrame:
        rows = known(rows)
        mean = F.broadcast(rows.agg(F.avg("value").alias("mean")))  # one number
        off = F.col("value") - F.col("mean")
        return rows.join(mean).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum(off).alias("x"), F.sum(off * off).alias("xx")).withColumn("side", F.lit(side))

    within = lambda shift: F.floor((F.col("step") + shift) / block)
    left = steps(a, 0).withColumn("block", within(0))
    right = steps(b, 1).withColumn("block", F.explode(F.array_distinct(F.array(within(-most_lag), within(most_lag)))))
    kind = "lag long, n double, x double, y double, xx double, yy double, xy double"
    columns = [F.col(c).cast("long").alias(c) for c in ("block", "side", "step", "n")] + [F.col("x"), F.col("xx")]
    sums = left.select(*columns).unionByName(right.select(*columns)).groupBy("block").applyInPandas(_block_sums(most_lag, block), kind)
    total = sums.groupBy("lag").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]).filter("n > 0")
    spread = lambda s, ss: F.col("n") * F.col(ss) - F.col(s) * F.col(s)
    varies = lambda s, ss: spread(s, ss) > 1e-11 * F.col("n") * F.col(ss)
    both = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread("x", "xx") * spread("y", "yy"))
    return total.select("lag", F.when((F.col("n") > 1) & varies("x", "xx") & varies("y", "yy"), both).alias("correlation"))
