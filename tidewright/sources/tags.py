"""Tag histories: one headless CSV file for each tag, ts;value with a decimal comma, or files of many tags, tag;ts;value."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import units

#: Fixed value: how times are written.
TIME = "d.M.yyyy H:mm:ss"
TIME_OUT = "dd.MM.yyyy HH:mm:ss"
#: How write_shared() writes a null tag; no encoded one is spelled so.
NO_TAG = "%"


def number(text: Column) -> Column:
    """A number with either decimal separator; null if it isn't one."""
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def moment(text: Column) -> Column:
    return F.try_to_timestamp(F.trim(text), F.lit(TIME))


def _files_of(spark: SparkSession, path: str, only: list[str]) -> list[str]:
    """What a folder has of the tags only, as <tag>.csv or as write_tags() put it; a tag that has neither raises.

    The store is asked for these names, not for a listing, so neither the other
    files nor their number matter.
    """
    found = []
    for tag in dict.fromkeys(only):
        here = []
        for name in (f"{quote(tag, safe=' ')}.csv", f"{tag}.csv", f"tag={quote(tag, safe=' ')}", f"tag={tag}"):
            at = spark._jvm.org.apache.hadoop.fs.Path(path, name.replace(":", "%3A"))
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) and at.toString() not in here:
                here.append(at.toString())
        if not here:
            raise ValueError(f"no file of the tag {tag}")
        found += here
    return found


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    path_of = F.input_file_name()
    folder = F.regexp_extract(path_of, r"/tag=([^/]+)/", 1)
    name = F.when(folder != "", folder).otherwise(F.regexp_extract(path_of, r"([^/]+)\.csv$", 1))
    return spark.read.schema("ts string, text string, status string").option("sep", ";").csv(path).select(F.url_decode(name).alias("tag"), moment(F.col("ts")).alias("ts"), F.trim("text").alias("text"), F.trim("status").alias("status"))


def read_tags(spark: SparkSession, path: str, begin: str | None = None, end: str | None = None, kind: str = "double", only: list[str] | None = None) -> DataFrame:
    """tags(tag, ts, value) of all <tag>.csv files that path (a folder or a glob) matches, or of what write_tags() wrote there, in one scan; begin and end are both within.

    With only, a list of tags, path is a folder and no other tag's file is read.
    kind is double, int or boolean; a boolean other than 0 or 1 raises.
    """
    if only is not None and not only:
        raise ValueError("only names no tag")
    return _between(_lines(spark, path if only is None else _files_of(spark, path, only)), begin, end, kind)


def read_shared(spark: SparkSession, path: str, begin: str | None = None, end: str | None = None, kind: str = "double") -> DataFrame:
    """tags(tag, ts, value) of what write_shared() wrote, as read_tags() has them."""
    rows = spark.read.schema("tag string, ts string, text string, status string").option("sep", ";").csv(path)
    tag = F.when(F.col("tag") == NO_TAG, None).otherwise(F.url_decode(F.coalesce("tag", F.lit(""))))
    return _between(rows.select(tag.alias("tag"), moment(F.col("ts")).alias("ts"), F.trim("text").alias("text"), F.trim("status").alias("status")), begin, end, kind)


def _between(lines: DataFrame, begin: str | None, end: str | None, kind: str) -> DataFrame:
    rows = lines.filter("ts is not null")
    if begin is not None:
        rows = rows.filter(F.col("ts") >= F.lit(begin).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    text = F.col("text")
    if kind == "double":
        value = number(text)
    elif kind == "int":
        value = text.try_cast("int")
    elif kind == "boolean":
        value = F.when(text == "1", True).when(text == "0", False).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), F.coalesce(text, F.lit("null")))).cast("boolean"))
    else:
        raise ValueError(f"unknown kind {kind}")
    return rows.select("tag", "ts", value.alias("value"))


def read_bound_tags(spark: SparkSession, path: str, bindings: DataFrame, **options) -> DataFrame:
    """measurements of tags in SI at their places: bindings(tag, dim, ...) meet the readings by tag."""
    return read_tags(spark, path, **options).join(bindings, "tag").withColumn("value", units.to_si(F.col("value"), F.col("dim"))).drop("dim")


def read_valve_states(spark: SparkSession, path: str, **options) -> DataFrame:
    """controls(tag, ts, is_opened) of tags that hold valve codes."""
    return read_tags(spark, path, kind="int", **options).select("tag", "ts", units.open_by_code(F.col("value")).alias("is_opened"))


def _written(tags: DataFrame) -> list[Column]:
    return [F.date_format("ts", TIME_OUT).alias("ts"), F.col("value").cast("string").alias("value")] + ([F.col("status").cast("string").alias("status")] if "status" in tags.columns else [])


def write_shared(tags: DataFrame, path: str) -> None:
    """tag;ts;value (and ;status, if there is one) of all tags, in ranges of tag and time.

    Files are as many as the rows ask for, not as the tags, each of which
    otherwise costs a folder, a file and a look for both; a tag with many
    readings goes on in the next file. Tags are spelled as in an address, so
    that any text is one field of a line.
    """
    dealt = tags.repartitionByRange("tag", "ts").sortWithinPartitions("tag", "ts")
    dealt.select(F.coalesce(F.url_encode("tag"), F.lit(NO_TAG)).alias("tag"), *_written(tags)).write.mode("overwrite").option("sep", ";").csv(path)


def write_tags(tags: DataFrame, path: str, by: list[str] | None = None) -> None:
    """ts;value (and ;status, if there is one) below a folder for each tag, or for each combination of by; for many thousands of tags there is write_shared()."""
    keys = by or ["tag"]
    tags.select(*keys, *_written(tags)).repartition(*keys).sortWithinPartitions(*keys, "ts").write.mode("overwrite").partitionBy(*keys).option("sep", ";").csv(path)


def write_profile(points: DataFrame, path: str) -> None:
    """x;height of points(pipe, x, height), below a folder for each pipe, in order of x."""
    points.select("pipe", F.col("x").cast("string").alias("at"), F.col("height").cast("string").alias("height"), "x").repartition("pipe").sortWithinPartitions("pipe", "x").drop("x").write.mode("overwrite").partitionBy("pipe").option("sep", ";").csv(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """(x, height) of a pipe's profile; decimal comma or point."""
    rows = spark.read.schema("x string, height string").option("sep", ";").csv(path)
    return rows.select(number(F.col("x")).alias("x"), number(F.col("height")).alias("height")).filter("x is not null")


def synthetic(spark: SparkSession, levels: dict[str, float], n: int, step_seconds: int, spread: float = 0.02, jitter: float = 0.5, seed: int = 7, start: str = "2025-01-01") -> DataFrame:
    """tags of seeded readings around given levels, at uneven steps: each time is its even one moved by up to half of jitter."""
    names = F.explode(F.create_map(*[F.lit(x) for kv in levels.items() for x in (kv[0], float(kv[1]))])).alias("tag", "level")
    rows = spark.range(n).select("id", names)
    draw = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "tag", "id"), F.lit(1 << 53)) / F.lit(float(1 << 53))) - 0.5
    seconds = (F.col("id") + draw(1) * jitter) * step_seconds
    base = F.unix_micros(F.lit(start).cast("timestamp"))
    return rows.select("tag", F.timestamp_micros((base + seconds * 1_000_000).cast("long")).alias("ts"), (F.col("level") * (1 + 2 * spread * draw(2))).alias("value"))


def with_jump(tags: DataFrame, tag: str, since: str, jump: float) -> DataFrame:
    """tags with a constant added to one of them from a time on."""
    hit = (F.col("tag") == tag) & (F.col("ts") >= F.lit(since).cast("timestamp"))
    return tags.withColumn("value", F.when(hit, F.col("value") + jump).otherwise(F.col("value")))
