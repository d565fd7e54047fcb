"""Mixing of transported properties at vertices, and what measurements make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalar import fix_small

#: Which quantities count together when a property's average is taken.
FAMILIES = {"density_working": "density", "density_std": "density", "mass_flow_improver": "improver", "vol_flow_improver": "improver"}


def weighted_mean(weight: Column, value: Column) -> Column:
    """Aggregate: sum(weight * value) / sum(weight); a single value as it is; small weights are moved off zero where all sum to less than 1e-8."""
    w = fix_small(weight)
    tiny = F.abs(F.sum(weight)) < 1e-8
    return F.when(F.count(value) == 1, F.max(value)).when(tiny, F.sum(w * value) / F.sum(w)).otherwise(F.sum(weight * value) / F.sum(weight))


def mixed(inlets: DataFrame, density: str | None = "density", viscosity: str | None = None, confidence: str | None = None, at: str = "vertex", weight: str = "flow") -> DataFrame:
    """inlets(vertex, flow, properties) mixed at each vertex: densities by flow, viscosities by the cube of the mean cube root, confidences by and."""
    out = []
    if density:
        out.append(weighted_mean(F.col(weight), F.col(density)).alias(density))
    if viscosity:
        out.append(F.pow(weighted_mean(F.col(weight), F.cbrt(viscosity)), F.lit(3.0)).alias(viscosity))
    if confidence:
        out.append(F.bool_and(confidence).alias(confidence))
    return inlets.groupBy(at).agg(*out)


def averages(measured: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """(family, value, confident): the mean of each family of measured(mtype, value), or its default; never confident."""
    spark = measured.sparkSession
    names = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    found = measured.filter("value is not null and not isnan(value)").groupBy(F.coalesce(F.try_element_at(names, F.col("mtype")), F.col("mtype")).alias("family")).agg(F.avg("value").alias("mean"))
    asked = spark.createDataFrame(list(defaults.items()), "family string, usual double")
    return asked.join(found, "family", "left").select("family", F.coalesce("mean", "usual").alias("value"), F.lit(False).alias("confident"))


def overwritten(computed: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """computed(keys, value, confident) with measured values in their place, of several the last by seq.

    A measured value is confident; replaced is what was computed there, and
    status tells whether that was a confident calculation.
    """
    last = measured.groupBy(*keys).agg(F.max_by("value", "seq").alias("measured"))
    both = computed.join(last, keys, "left")
    hit = F.col("measured").isNotNull()
    return both.select(
        *keys,
        F.coalesce("measured", "value").alias("value"),
        (hit | F.col("confident")).alias("confident"),
        F.when(hit, F.col("value")).alias("replaced"),
        F.when(hit, F.when(F.col("confident"), "confident_calculation").otherwise("inconfident_calculation")).otherwise("unused").alias("status"),
    )
