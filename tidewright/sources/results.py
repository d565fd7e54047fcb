"""Results: layers of buffers as JSON, and a history of layers by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def layers(pipes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(step, value): one JSON text for each step of pipes(step, name, flow, coordinates, profiles) and sources(step, name, flow); numbers are texts."""
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    shaped = pipes.select("step", "name", F.struct(F.col("flow").cast("string").alias("std_volumetric_flow"), text("coordinates").alias("coordinates"), F.transform_values("profiles", lambda _, v: text(v)).alias("profiles")).alias("o"))
    by_step = shaped.groupBy("step").agg(F.map_from_entries(F.collect_list(F.struct("name", "o"))).alias("pipes"))
    if sources is not None:
        own = sources.select("step", "name", F.struct(F.col("flow").cast("string").alias("std_volumetric_flow")).alias("o")).groupBy("step").agg(F.map_from_entries(F.collect_list(F.struct("name", "o"))).alias("sources"))
        by_step = by_step.join(own, "step", "full")
    buffers = [c for c in by_step.columns if c != "step"]
    return by_step.select("step", F.to_json(F.struct(F.col("step").cast("string").alias("step"), F.struct(*buffers).alias("buffers"))).alias("value"))


def write_layers(rows: DataFrame, path: str) -> None:
    rows.select("value").write.mode("overwrite").text(path)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(step, name, flow) of the sources of written layers."""
    shape = "struct<step:string,buffers:struct<sources:map<string,struct<std_volumetric_flow:string>>>>"
    rows = spark.read.text(path).select(F.from_json("value", shape).alias("l")).select(F.col("l.step").cast("long").alias("step"), F.explode("l.buffers.sources").alias("name", "o"))
    return rows.select("step", "name", F.col("o.std_volumetric_flow").try_cast("double").alias("flow"))


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """(step, name, flow, coordinates, profiles) of the pipes of written layers."""
    shape = "struct<step:string,buffers:struct<pipes:map<string,struct<std_volumetric_flow:string,coordinates:array<string>,profiles:map<string,array<string>>>>>>"
    rows = spark.read.text(path).select(F.from_json("value", shape).alias("l")).select(F.col("l.step").cast("long").alias("step"), F.explode("l.buffers.pipes").alias("name", "o"))
    numbers = lambda c: F.transform(c, lambda x: x.try_cast("double"))
    return rows.select("step", "name", F.col("o.std_volumetric_flow").try_cast("double").alias("flow"), numbers("o.coordinates").alias("coordinates"), F.transform_values("o.profiles", lambda _, v: numbers(v)).alias("profiles"))


def save_history(rows: DataFrame, path: str) -> None:
    """Layers as Parquet by step: a step is restored by reading its folder alone."""
    rows.repartition("step").write.mode("append").partitionBy("step").parquet(path)


def restore(spark: SparkSession, path: str, step: int) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("step") == step)
