"""Data of a batch from tags in one plan: a time grid, classified measurements at each of its steps, and controls at theirs.

One long table holds all of it: (step, t, role, name, mtype, value, at), with
role flow or endogenous for what is measured, and state or opening for what is
switched; at is when a switching was told. Names are the objects that tags are
bound to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import units
from tidewright.operators import series

FLOW, ENDOGENOUS, STATE, OPENING = "flow", "endogenous", "state", "opening"
#: What kinds of objects an opening can be told to.
OPENED = ("resistance", "valve")
#: Steps that one row of a tag's grid is unfolded to.
PIECE = 10_000


def bounds(measurements: DataFrame, switchings: DataFrame | None = None, initial_as_control: bool = True, extrapolate_last: bool = True) -> DataFrame:
    """(t_start, t_end) of a batch: the time that all measured tags cover.

    If the initial states aren't taken as controls, it begins no sooner than
    every switched object is known; if last switchings don't hold on, it ends
    no later than the first object's last. A time without length raises, and so
    do both without switchings.
    """
    whole = series.period(measurements)
    if not (initial_as_control and extrapolate_last):
        if switchings is None:
            raise ValueError("bounds by switchings need switchings")
        told = switchings.filter("value is not null").groupBy("tag").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).agg(F.max("first").alias("c_start"), F.min("last").alias("c_end"))
        start = F.col("t_start") if initial_as_control else F.greatest("t_start", "c_start")
        end = F.col("t_end") if extrapolate_last else F.least("t_end", "c_end")
        whole = whole.join(F.broadcast(told)).select(start.alias("t_start"), end.alias("t_end"))  # one row
    empty = F.coalesce(F.col("t_start") >= F.col("t_end"), F.lit(False))
    return whole.filter(F.when(empty, F.raise_error(F.lit("measurements and switchings leave no time to model")).cast("boolean")).otherwise(F.lit(True)))


def _gridded(tags: DataFrame, span: DataFrame, step_seconds: int) -> DataFrame:
    """(tag, step, t) of each tag at each time of the grid, its end excluded, unfolded in pieces that are dealt over tasks."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    n = F.ceil((micros("t_end") - micros("t_start")) / (step_seconds * 1_000_000))
    each = tags.select("tag").distinct().join(F.broadcast(span.select(n.alias("n"), micros("t_start").alias("a"))))  # one row
    pieces = each.filter("n > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE)))).repartition("tag", "piece")
    steps = F.explode(F.sequence(F.col("piece") * PIECE, F.least((F.col("piece") + 1) * PIECE, "n") - 1))
    kind = span.schema["t_start"].dataType
    return pieces.withColumn("step", steps).select("tag", "step", F.timestamp_micros(F.col("a") + F.col("step") * step_seconds * 1_000_000).cast(kind).alias("t"))


def _at_steps(switchings: DataFrame, span: DataFrame, step_seconds: int, role: Column) -> DataFrame:
    """switchings(name, ts, value) at the last grid time at or before theirs; those after the grid's end are its last step's, those before its start take no part."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = span.select("t_start", (F.ceil((micros("t_end") - micros("t_start")) / (step_seconds * 1_000_000)) - 1).alias("last"))
    kind = span.schema["t_start"].dataType
    here = switchings.filter("ts is not null and value is not null").join(F.broadcast(span)).filter(F.col("ts") >= F.col("t_start"))  # one row
    step = F.least(series.grid_step(F.col("ts"), F.col("t_start"), step_seconds), "last")
    t = F.timestamp_micros(micros("t_start") + F.col("step") * step_seconds * 1_000_000).cast(kind)
    return here.withColumn("step", step).select("step", t.alias("t"), role.alias("role"), "name", F.lit(None).cast("string").alias("mtype"), F.col("value").cast("double").alias("value"), F.col("ts").alias("at"))


def transport(tags: DataFrame, bindings: DataFrame, step_seconds: int, switchings: DataFrame | None = None, initial_as_control: bool = True, extrapolate_last: bool = True) -> DataFrame:
    """The batch of a transport: tags(tag, ts, value) at bindings(tag, name, mtype, dim), switchings(tag, name, ts, value) of states 0 or 1.

    Only bound tags bear on the grid. A tag is looked up once for each step and
    handed to all its bindings, in SI; between readings it is linear. Several
    switchings of an object in one step are all there, the last one at counts.
    """
    bound = tags.join(bindings.select("tag").distinct(), "tag", "left_semi")
    span = bounds(bound, switchings, initial_as_control, extrapolate_last)
    read = series.interpolated(_gridded(bound.filter("value is not null"), span, step_seconds), bound)
    placed = read.join(bindings, "tag").select(
        "step", "t", F.when(units.is_flow(F.col("mtype")), FLOW).otherwise(ENDOGENOUS).alias("role"), "name", "mtype",
        units.to_si(F.col("value"), F.col("dim")).alias("value"), F.lit(None).cast(tags.schema["ts"].dataType).alias("at"),
    )
    if switchings is None:
        return placed
    flag = F.when(F.col("value").isin(0, 1), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a state: "), F.col("value").cast("string"))).cast("double"))
    told = switchings.filter("value is not null").withColumn("value", flag)
    return placed.unionByName(_at_steps(told, span, step_seconds, F.lit(STATE)))


def hydraulic(batch_span: DataFrame, step_seconds: int, openings: DataFrame, objects: DataFrame) -> DataFrame:
    """Openings(name, ts, value) on the grid of a transport, whose bounds are given: the rows that a hydraulic batch adds.

    objects(name, kind) tell what can be opened; a switching of any other kind,
    or of an object that isn't there, raises.
    """
    known = openings.join(objects.select("name", "kind"), "name", "left")
    fits = F.coalesce(F.col("kind").isin(*OPENED), F.lit(False))
    failed = F.raise_error(F.concat(F.lit("no opening can be told to "), F.col("name"), F.lit(": "), F.coalesce("kind", F.lit("unknown")))).cast("double")
    return _at_steps(known.withColumn("value", F.when(fits, F.col("value")).otherwise(failed)), batch_span, step_seconds, F.lit(OPENING))


def with_reference(tags: DataFrame, names: list[str], step_seconds: int = 60) -> DataFrame:
    """(step, t, parameters, reference) of the named tags on one grid: the last of them is what a model is held against.

    parameters are the values of the other ones in their order. The grid covers
    the time that all named tags cover; a tag without readings leaves no rows,
    and neither do no tags.
    """
    if len(set(names)) != len(names) or len(names) < 2:
        raise ValueError("a reference needs different tags before it")
    mine = tags.filter(F.col("tag").isin(*names) & F.col("value").isNotNull())
    there = mine.agg(F.countDistinct("tag").alias("there"))
    span = bounds(mine).join(F.broadcast(there)).filter(F.col("there") == len(names)).drop("there")  # one row
    read = series.interpolated(_gridded(mine, span, step_seconds), mine)
    of = lambda name: F.max(F.when(F.col("tag") == name, F.col("value")))
    return read.groupBy("step", "t").agg(F.array(*[of(n) for n in names[:-1]]).alias("parameters"), of(names[-1]).alias("reference"))
