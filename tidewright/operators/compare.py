"""Computed against measured series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONFIDENT = "confident_calculation"


def confident_pairs(computed: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, computed, measured) where computed(keys, value, status) is a confident calculation."""
    sure = computed.filter(F.col("status") == CONFIDENT).select(*keys, F.col("value").alias("computed"))
    return sure.join(measured.select(*keys, F.col("value").alias("measured")), keys)


def confident_steps(computed: DataFrame, place: str = "place") -> DataFrame:
    """(place, steps): the steps at which each place is a confident calculation."""
    return computed.filter(F.col("status") == CONFIDENT).groupBy(place).agg(F.array_sort(F.collect_list("step")).alias("steps"))


def with_any_confidence(computed: DataFrame, place: str = "place") -> DataFrame:
    """Series of places that are a confident calculation at least once."""
    return computed.join(computed.filter(F.col("status") == CONFIDENT).select(place).distinct(), place, "left_semi")


def error_histogram(pairs: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, low, n) of computed - measured over equal bins from the least to the greatest error, the last one closed."""
    errors = pairs.select((F.col("computed") - F.col("measured")).alias("error")).filter("error is not null")
    ends = errors.agg(F.min("error").alias("a"), F.max("error").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    placed = errors.join(F.broadcast(ends)).withColumn("bin", F.when(width > 0, F.least(F.floor((F.col("error") - F.col("a")) / width), F.lit(bins - 1))).otherwise(0))  # one row
    return placed.groupBy("bin").agg(F.first(F.col("a") + F.col("bin") * width).alias("low"), F.count(F.lit(1)).alias("n"))


def shifted_by_best_lag(computed: DataFrame, measured: DataFrame, most_lag: int, width: int) -> tuple[DataFrame, int]:
    """measured(step, value) moved to where its increments correlate most with computed's, both smoothed by a centred mean, and that lag."""
    from tidewright.operators.series import lag_correlations

    def increments(rows: DataFrame) -> DataFrame:
        frame = Window.orderBy("step").rowsBetween(-(width // 2), width // 2)
        mean = rows.withColumn("mean", F.when(F.count("value").over(frame) == 2 * (width // 2) + 1, F.avg("value").over(frame)))
        return mean.withColumn("value", F.col("mean") - F.lag("mean").over(Window.orderBy("step"))).filter("value is not null").select("step", "value")

    best = lag_correlations(increments(computed), increments(measured), most_lag).orderBy(F.desc(F.abs("correlation")), F.abs("lag"), "lag").first()
    lag = int(best["lag"]) if best else 0
    return measured.withColumn("step", F.col("step") - lag), lag
