"""Network schemes: folders of JSON maps from names to topology and parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import units

#: The files of a scheme, the fields of their objects with defaults (null where there is none).
FIELDS = {
    "pipe": [("X_start", "double", None), ("X_end", "double", None), ("Diameter", "double", None)],
    "source": [("is_initially_zeroflow", "boolean", False), ("density", "double", None), ("temperature", "double", None), ("pressure", "double", None), ("std_volflow", "double", None)],
    "lumped": [("is_initially_opened", "boolean", True)],
    "valve": [("initial_opening", "double", None), ("xi", "double", None), ("diameter", "double", None)],
    "pump": [("head_characteristic", "array<double>", None), ("initial_frequency", "double", None), ("nominal_frequency", "double", None), ("rotor_wheel_reducing", "double", None), ("is_initially_started", "boolean", True)],
    "check_valve": [("hydraulic_resistance", "double", None), ("diameter", "double", None), ("opening", "double", None), ("is_initially_closed_static", "string", None)],
}
#: Keys of control tags.
CONTROLS = ["valve_state_scada", "pump_state_scada"]


@dataclass
class Scheme:
    """edges(name, edge_type, edge, from_v, to_v, obj_type), one table of parameters for each type, tags and control tags."""

    edges: DataFrame
    objects: dict[str, DataFrame]
    tags: DataFrame
    controls: DataFrame


def _documents(spark: SparkSession, source: str | list[str] | DataFrame, inline: bool) -> DataFrame:
    """value: one document a row, from a path, from texts, or from a DataFrame's first column."""
    if isinstance(source, DataFrame):
        return source.select(F.col(source.columns[0]).alias("value"))
    if inline:
        return spark.createDataFrame([(s,) for s in ([source] if isinstance(source, str) else source)], "value string")
    return spark.read.text(source, wholetext=True)


def named(docs: DataFrame, struct: str, under: str | None = None) -> DataFrame:
    """(name, o): the entries of JSON maps of names to objects, or of the map below a key, if that key is there."""
    maps = F.from_json("value", f"map<string,{struct}>", {"mode": "FAILFAST"})
    if under:
        inner = F.get_json_object("value", f"$.{under}")
        maps = F.when(inner.isNotNull(), F.from_json(inner, f"map<string,{struct}>")).otherwise(F.from_json("value", f"map<string,{struct}>"))
    return docs.select(F.explode(maps).alias("name", "o"))


def read_topology(spark: SparkSession, source: str, inline: bool = False) -> DataFrame:
    """edges(name, edge_type, from_v, to_v): an object with one end only is of type Edge1."""
    rows = named(_documents(spark, source, inline), "struct<from:bigint,to:bigint>").select("name", F.col("o.from").alias("from_v"), F.col("o.to").alias("to_v"))
    return rows.select("name", F.when(F.col("from_v").isNull() | F.col("to_v").isNull(), "Edge1").otherwise("Edge2").alias("edge_type"), "from_v", "to_v")


def read_objects(spark: SparkSession, source: str, kind: str, inline: bool = False) -> DataFrame:
    """(name, fields) of objects of a kind; fields that are missing have their defaults, and a pipe without one of its three raises."""
    struct = "struct<" + ",".join(f"{n}:{t}" for n, t, _ in FIELDS[kind]) + ">"
    rows = named(_documents(spark, source, inline), struct, "pipes" if kind == "pipe" else None)
    out = rows.select("name", *[(F.col(f"o.{n}") if d is None else F.coalesce(f"o.{n}", F.lit(d))).alias(n) for n, _, d in FIELDS[kind]])
    if kind == "check_valve":
        state = F.lower("is_initially_closed_static")
        out = out.withColumn("is_initially_closed_static", F.when(state == "true", True).when(state == "false", False))
    if kind == "pipe":
        lacks = F.col("X_start").isNull() | F.col("X_end").isNull() | F.col("Diameter").isNull()
        out = out.withColumn("Diameter", F.when(lacks, F.raise_error(F.concat(F.lit("a pipe lacks its size: "), "name")).cast("double")).otherwise(F.col("Diameter")))
    return out


def read_tag_bindings(spark: SparkSession, source: str, inline: bool = False) -> DataFrame:
    """(name, key, tag, dim) of objects' tags: a name alone, or an object with Tag and Dim."""
    rows = named(_documents(spark, source, inline), "map<string,string>").select("name", F.explode("o").alias("key", "text"))
    spelled = F.when(F.col("text").startswith("{"), F.from_json("text", "struct<Tag:string,Dim:string>"))
    return rows.select("name", "key", F.coalesce(spelled["Tag"], F.col("text")).alias("tag"), F.coalesce(spelled["Dim"], F.lit("")).alias("dim"))


def measured(bindings: DataFrame) -> DataFrame:
    """(name, mtype, side, tag, dim) of tags that measure; an unknown quantity raises."""
    mtype, side = units.quantity_and_side(F.col("key"))
    rows = bindings.filter(~F.col("key").isin(CONTROLS)).select("name", mtype.alias("mtype"), side.alias("side"), "tag", "dim")
    known = F.col("mtype").isin(units.MEASURED)
    return rows.withColumn("mtype", F.when(known, F.col("mtype")).otherwise(F.raise_error(F.concat(F.lit("no quantity is called "), "mtype"))))


def controls(bindings: DataFrame) -> DataFrame:
    return bindings.filter(F.col("key").isin(CONTROLS)).select("name", F.col("key").alias("kind"), "tag")


def read_scheme(spark: SparkSession, folder: str, tags_file: str | None = None) -> Scheme:
    """A scheme folder: topology.json and those of <kind>_data.json that are there, checked."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in fs.listStatus(path)}
    objects = {k: read_objects(spark, f"{folder}/{k}_data.json", k) for k in FIELDS if f"{k}_data.json" in there}
    empty = spark.createDataFrame([], "name string, key string, tag string, dim string")
    inline = empty
    for kind in objects:
        rows = named(_documents(spark, f"{folder}/{kind}_data.json", False), "struct<Tags:map<string,string>>", "pipes" if kind == "pipe" else None).select("name", F.explode("o.Tags").alias("key", "text"))
        spelled = F.when(F.col("text").startswith("{"), F.from_json("text", "struct<Tag:string,Dim:string>"))
        inline = inline.unionByName(rows.select("name", "key", F.coalesce(spelled["Tag"], F.col("text")).alias("tag"), F.coalesce(spelled["Dim"], F.lit("")).alias("dim")))
    bindings = inline.unionByName(read_tag_bindings(spark, tags_file)) if tags_file else inline
    return checked(read_topology(spark, f"{folder}/topology.json"), objects, bindings)


def checked(topology: DataFrame, objects: dict[str, DataFrame], bindings: DataFrame) -> Scheme:
    """The scheme of its parts; raises unless names are unique, edges and objects match, and tags belong to objects."""
    spark = topology.sparkSession
    named_objects = spark.createDataFrame([], "name string, obj_type string")
    for kind, rows in objects.items():
        named_objects = named_objects.unionByName(rows.select("name", F.lit(kind).alias("obj_type")))
    for what, bad in {
        "names of two objects": named_objects.groupBy("name").count().filter("count > 1"),
        "edges without an object": topology.join(named_objects, "name", "left_anti"),
        "objects without an edge": named_objects.join(topology, "name", "left_anti"),
        "tags of no object": bindings.join(named_objects, "name", "left_anti"),
    }.items():
        if found := [r["name"] for r in bad.select("name").limit(5).collect()]:
            raise ValueError(f"{what}: {', '.join(found)}")
    from tidewright.operators.graph import renumbered

    edges = topology.join(named_objects, "name")
    numbers = [renumbered(edges.filter(F.col("edge_type") == t), "name", "edge").withColumn("edge_type", F.lit(t)) for t in ("Edge1", "Edge2")]
    full = edges.join(numbers[0].unionByName(numbers[1]), ["name", "edge_type"])
    return Scheme(full.select("name", "edge_type", "edge", "from_v", "to_v", "obj_type"), objects, measured(bindings), controls(bindings))


def bounds(spark: SparkSession, source: str, inline: bool = False) -> tuple[DataFrame, DataFrame]:
    """measurements(step, name, vertex, mtype, side, value) and controls(step, kind, name, opening, is_opened, ...) of single- or multi-layer bounds."""
    control = "struct<pumps:map<string,string>,improvers:map<string,string>,valves:map<string,struct<opening:double,is_opened:boolean>>,sources:map<string,struct<pressure:double,std_vol_flow:double,density_std_out:double,viscosity_working:double,temperature:double>>>"
    layer = f"step:string,transport_measurements:array<struct<edge:string,vertex:bigint,type:string,value:double>>,controls:{control}"
    docs = _documents(spark, source, inline)
    many = F.from_json("value", f"struct<layers:array<struct<{layer}>>>")["layers"]
    layers = docs.select(F.explode(F.coalesce(many, F.array(F.from_json("value", f"struct<{layer}>")))).alias("l")).select(F.coalesce("l.step", F.lit("0")).alias("step"), "l.transport_measurements", "l.controls")
    refused = F.coalesce(F.size("controls.pumps"), F.lit(0)) + F.coalesce(F.size("controls.improvers"), F.lit(0)) > 0
    layers = layers.withColumn("step", F.when(refused, F.raise_error(F.lit("controls of pumps and improvers aren't supported"))).otherwise(F.col("step")))
    rows = layers.select("step", F.posexplode("transport_measurements").alias("seq", "m"))
    mtype, side = units.quantity_and_side(F.col("m.type"))
    measurements = rows.select("step", "seq", F.col("m.edge").alias("name"), F.col("m.vertex").alias("vertex"), mtype.alias("mtype"), side.alias("side"), F.col("m.value").alias("value"))
    none = lambda t: F.lit(None).cast(t)
    valves = layers.select("step", F.explode("controls.valves").alias("name", "o")).select("step", F.lit("valve").alias("kind"), "name", F.col("o.opening").alias("opening"), F.coalesce(F.col("o.is_opened"), F.col("o.opening") > 0).alias("is_opened"), none("double").alias("pressure"), none("double").alias("std_vol_flow"))
    sources = layers.select("step", F.explode("controls.sources").alias("name", "o")).select("step", F.lit("source").alias("kind"), "name", none("double").alias("opening"), none("boolean").alias("is_opened"), F.col("o.pressure").alias("pressure"), F.col("o.std_vol_flow").alias("std_vol_flow"))
    return measurements, valves.unionByName(sources)


def flag(text: Column) -> Column:
    """Confidence written as a boolean, a number or an array's first item."""
    first = F.trim(F.regexp_replace(text, r"^\s*\[\s*|\s*[,\]].*$", ""))
    return F.when(F.lower(first) == "true", True).when(F.lower(first) == "false", False).otherwise(first.try_cast("double") > 0)


def lumped_states(objects: dict[str, DataFrame]) -> DataFrame:
    """(name, is_opened) of everything that can be closed."""
    parts = [
        objects[kind].select("name", state.alias("is_opened"))
        for kind, state in {
            "lumped": F.col("is_initially_opened"),
            "valve": F.coalesce(F.col("initial_opening") > 0, F.lit(False)),
            "pump": F.col("is_initially_started"),
            "check_valve": ~F.coalesce(F.col("is_initially_closed_static"), F.lit(False)),
        }.items()
        if kind in objects
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
