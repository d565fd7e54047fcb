"""Transport of a property through a network, for all time steps at once.

The loop goes over the levels of the network, not over time: at each level one
grouped aggregation mixes what enters its vertices at every step, and the pipes
that leave them advect their whole histories, each pipe a task. A network's
topology is small and stays on the driver; its histories never do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.operators import advection, balance, mixing
from tidewright.operators.flows import flows_of
from tidewright.storage import written


@dataclass(frozen=True)
class Edge:
    """An object of the network: kind source, lumped or pipe; one end is None for sources and sinks."""

    name: str
    kind: str
    from_v: int | None
    to_v: int | None
    length: float = 0.0
    diameter: float = 0.0


def levels_of(edges: list[Edge]) -> dict[int, int]:
    """Level of each vertex along the edges' directions; raises on cycles."""
    before: dict[int, set[int]] = {}
    for e in edges:
        for v in (e.from_v, e.to_v):
            if v is not None:
                before.setdefault(v, set())
        if e.from_v is not None and e.to_v is not None:
            before[e.to_v].add(e.from_v)
    out: dict[int, int] = {}
    while len(out) < len(before):
        ready = [v for v, b in before.items() if v not in out and all(u in out for u in b)]
        if not ready:
            raise ValueError("the flows run in a circle")
        for v in ready:
            out[v] = 1 + max((out[u] for u in before[v]), default=-1)
    return out


def along_flows(edges: list[Edge], signs: dict[str, int]) -> list[Edge]:
    """edges turned so that every flow is positive; edges without a flow are left out."""
    return [e if signs[e.name] > 0 else Edge(e.name, e.kind, e.to_v, e.from_v, e.length, e.diameter) for e in edges if signs.get(e.name)]


def _latest(measured: DataFrame | None, kind: str, named: str) -> DataFrame | None:
    if measured is None:
        return None
    return measured.filter(F.col("place_kind") == kind).groupBy("step", F.col("place").alias(named)).agg(F.max_by("value", "seq").alias("seen"))


def transported(
    edges: list[Edge], flows: DataFrame, entering: DataFrame, measured: DataFrame | None = None, dt: float | None = None, initial: float = 860.0, rule: str = "linear", states: DataFrame | None = None
) -> DataFrame:
    """(step, name, inlet, outlet, confident, replaced) of every edge at every step.

    edges run along the flows(step, name, flow), which keep their directions;
    cut the steps where one turns. entering(name, nominal) are the sources'
    usual values, never confident. measured(step, place_kind, place, value,
    seq) has readings on edges (by name) and vertices (by number as text): they
    replace what is computed there, are confident, and the last by seq counts.
    A reading on a pipe is an error. Without dt pipes hand through what enters
    them; with it they advect, and the rows of each pipe's last step have its
    profile and trust, from which states(pipe, profile, trust, inlet) may go on.
    rule is linear, or cube_root for viscosities.

    Each level of the network is written once; a later level reads those tables
    only that its inlets are in.
    """
    spark = flows.sparkSession
    level = levels_of(edges)
    if measured is not None:
        pipes = [e.name for e in edges if e.kind == "pipe"]
        if measured.filter((F.col("place_kind") == "edge") & F.col("place").isin(pipes)).limit(1).count():
            raise ValueError("a property can't be measured on a pipe")
    on_edges, on_vertices = _latest(measured, "edge", "name"), _latest(measured, "vertex", "vertex")
    none = lambda t: F.lit(None).cast(t)
    columns = ["step", "name", "flow", "inlet", "outlet", "confident", "replaced", "profile", "trust"]

    def placed(rows: DataFrame, seen: DataFrame | None, key: str) -> DataFrame:
        if seen is None:
            return rows.withColumn("replaced", none("double"))
        joined = rows.join(seen, ["step", key], "left")
        hit = F.col("seen").isNotNull()
        return joined.select(*[c for c in rows.columns if c not in ("value", "confident")], F.coalesce("seen", "value").alias("value"), (hit | F.col("confident")).alias("confident"), F.when(hit, F.col("value")).alias("replaced"))

    def through(rows: DataFrame, group: list[Edge]) -> DataFrame:
        """rows(step, name, flow, value, confident) at the edges' inlets, to their outlets."""
        lumped = placed(rows.filter(F.col("name").isin([e.name for e in group if e.kind != "pipe"])), on_edges, "name")
        out = lumped.select("step", "name", "flow", F.col("value").alias("inlet"), F.col("value").alias("outlet"), "confident", "replaced", none("array<double>").alias("profile"), none("array<double>").alias("trust"))
        tubes = [(e.name, e.length, e.diameter) for e in group if e.kind == "pipe"]
        if tubes:
            inside = rows.filter(F.col("name").isin([t[0] for t in tubes]))
            if dt is None:
                moved = inside.select("step", "name", "flow", F.col("value").alias("inlet"), F.col("value").alias("outlet"), "confident", none("array<double>").alias("profile"), none("array<double>").alias("trust"))
            else:
                table = spark.createDataFrame(tubes, "pipe string, length double, diameter double")
                ran = advection.advected(inside.withColumnRenamed("name", "pipe"), table, dt, initial, profiles="last", states=states).withColumnRenamed("pipe", "name")
                moved = inside.select("step", "name", "flow").join(ran, ["step", "name"])
            out = out.unionByName(moved.withColumn("replaced", none("double")).select(columns))
        return out.select(columns)

    first = [e for e in edges if e.from_v is None]
    usual = entering.select("name", F.col("nominal").alias("value"))
    now = flows.filter(F.col("name").isin([e.name for e in first])).join(usual, "name", "left").withColumn("confident", F.lit(False)).select("step", "name", F.abs("flow").alias("flow"), "value", "confident")
    done = [written(through(now, [Edge(e.name, "source", e.from_v, e.to_v) for e in first]), "transport")]
    table_of = {e.name: 0 for e in first}
    for at in range(max(level.values(), default=-1) + 1):
        vertices = {v for v, n in level.items() if n == at}
        group = [e for e in edges if e.from_v in vertices]
        if not group:
            continue
        coming = [(e.name, e.to_v) for e in edges if e.to_v in vertices]
        # what is broadcast here is at most the list of edges, which the driver holds already
        ends = spark.createDataFrame(coming or [("", -1)], "name string, vertex long")
        starts = spark.createDataFrame([(e.name, e.from_v) for e in group], "name string, vertex long")
        before = [done[i] for i in sorted({table_of[n] for n, _ in coming if n in table_of})] or [done[0]]
        told = before[0]
        for t in before[1:]:
            told = told.unionByName(t)
        inlets = told.join(F.broadcast(ends), "name").filter("outlet is not null").withColumn("share", F.cbrt("outlet") if rule == "cube_root" else F.col("outlet"))
        mean = mixing.weighted_mean(F.col("flow"), F.col("share"))
        mixed = inlets.groupBy("step", "vertex").agg((F.pow(mean, F.lit(3.0)) if rule == "cube_root" else mean).alias("value"), F.bool_and("confident").alias("confident"))
        seen = on_vertices.withColumn("vertex", F.col("vertex").cast("long")) if on_vertices is not None else None
        mixed = placed(mixed, seen, "vertex").drop("replaced")
        into = flows.select("step", "name", F.abs("flow").alias("flow")).join(F.broadcast(starts), "name").join(mixed, ["step", "vertex"], "left").select("step", "name", "flow", "value", F.coalesce("confident", F.lit(False)).alias("confident"))
        table_of |= {e.name: len(done) for e in group}
        done.append(written(through(into, group), "transport"))
    out = done[0]
    for t in done[1:]:
        out = out.unionByName(t)
    return out


#: Flows may turn so often in a history: each run between turns is a job for each level.
MOST_RUNS = 200
REST = 1e-12


def runs_of(flows: DataFrame) -> list[int]:
    """The steps at which runs begin in which no flow of flows(step, name, flow) turns, stops or sets off.

    Turns are found edge by edge, and only their steps reach the driver, MOST_RUNS at most: more are an error.
    """
    sign = F.when(F.col("flow") > REST, 1).when(F.col("flow") < -REST, -1).otherwise(0)
    before = F.lag(sign).over(Window.partitionBy("name").orderBy("step"))
    turns = flows.select("step", (sign != before).alias("turned")).filter("turned").select("step").distinct()
    first = flows.agg(F.min("step")).first()[0]
    found = [r["step"] for r in turns.limit(MOST_RUNS + 1).collect()]
    if len(found) > MOST_RUNS:
        raise ValueError(f"the flows turn at more than {MOST_RUNS} steps")
    return [] if first is None else [first, *sorted(found)]


def lumped_loops(edges: list[Edge], metered: list[str]) -> tuple[list[Edge], dict[str, tuple[int, list[str]]]]:
    """edges with each loop of lumped objects as a mixing vertex of its own, and {connector: (loop, its edges)}.

    A loop's vertices keep their numbers; a connector named "loop i at v" joins
    each to the loop's vertex, which mixes what comes in and hands it to all
    that goes out. Two parallel edges are no loop here, as each carries half. A
    loop with a pipe in it is an error: its edges' flows aren't known.
    """
    by_name = {e.name: e for e in edges}
    listed = [(e.name, e.from_v, e.to_v) for e in edges]
    hub = 1 + max((v for e in edges for v in (e.from_v, e.to_v) if v is not None), default=0)
    out, connectors, inside = [], {}, set()
    for i, loop in enumerate(balance.loops_of(listed, metered)):
        if len(loop) == 2 and {by_name[loop[0]].from_v, by_name[loop[0]].to_v} == {by_name[loop[1]].from_v, by_name[loop[1]].to_v}:
            continue
        if tubes := [e for e in loop if by_name[e].kind == "pipe"]:
            raise ValueError(f"pipes in a loop whose flows aren't known: {', '.join(sorted(tubes))}")
        inside |= set(loop)
        for v in sorted({v for e in loop for v in (by_name[e].from_v, by_name[e].to_v)}):
            name = f"loop {i} at {v}"
            connectors[name] = (i, sorted(loop))
            out.append(Edge(name, "lumped", v, hub + i))
    return [e for e in edges if e.name not in inside] + out, connectors


def metered_transport(edges: list[Edge], meters: DataFrame, entering: DataFrame, **options) -> tuple[DataFrame, list[str], list[str]]:
    """transported() with flows that follow from meters(step, name, flow), and the useless meters and edges without a flow.

    The flows' combination is compiled once for the network. Loops of lumped
    objects are mixing vertices: their edges have the mixture and no flow of
    their own. Where flows turn, stop or set off the steps are cut, each run is
    transported along its own directions, and pipes go on from what they held.
    """
    spark = meters.sparkSession
    named = sorted(r["name"] for r in meters.select("name").distinct().collect())
    tree, connectors = lumped_loops(edges, named)
    known, useless, lacking = balance.compile_block_flows([(e.name, e.from_v, e.to_v) for e in edges], named, halve_pairs=True, connectors=True)
    inside = {e for _, loop in connectors.values() for e in loop}
    known = {(f"loop {e[1]} at {e[2]}" if isinstance(e, tuple) else e): c for e, c in known.items()}
    if bad := [e for e in lacking if e not in inside] + [e.name for e in tree if e.name not in known and e.name not in lacking]:
        raise ValueError(f"edges without a flow: {', '.join(bad)}")
    known = {e.name: known[e.name] for e in tree}
    flows = flows_of(meters.select(F.col("step").alias("t"), F.col("name").alias("edge"), F.col("flow").alias("value")), known).select(F.col("t").alias("step"), F.col("edge").alias("name"), "flow")
    flows = written(flows, "flows")
    begins = runs_of(flows)
    by_name, found, states = {e.name: e for e in tree}, None, {}
    for at, begin in enumerate(begins):
        here = flows.filter(F.col("step") >= begin)
        if at + 1 < len(begins):
            here = here.filter(F.col("step") < begins[at + 1])
        signs = {r["name"]: (r["flow"] > REST) - (r["flow"] < -REST) for r in flows.filter(F.col("step") == begin).collect()}
        turned = along_flows(tree, signs)
        held = {n: (p[::-1], t[::-1], v) if d != signs.get(n) else (p, t, v) for n, (d, p, t, v) in states.items() if signs.get(n)}
        told = spark.createDataFrame([(n, p, t, v) for n, (p, t, v) in held.items()], "pipe string, profile array<double>, trust array<double>, inlet double") if held else None
        rows = transported(turned, here.filter(F.col("name").isin([e.name for e in turned])), entering, states=told, **options)
        if at + 1 < len(begins):  # what pipes hold, a row of cells each, as the network is on the driver
            for r in rows.filter("profile is not null").select("name", "profile", "trust", "inlet").collect():
                states[r["name"]] = (signs[r["name"]], r["profile"], r["trust"], r["inlet"])
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = transported([], flows, entering)
    if connectors:
        first = {}
        for name, (i, loop) in connectors.items():
            first.setdefault(i, (name, loop))
        out_of = spark.createDataFrame([(f"loop {i} at {v}", i) for i, v in {(i, by_name[n].from_v) for n, (i, _) in connectors.items()}], "name string, loop int")
        leaving = found.join(F.broadcast(out_of), "name").join(flows.withColumnRenamed("flow", "signed"), ["step", "name"]).filter(F.col("signed") < 0)
        mixture = leaving.groupBy("step", "loop").agg(F.max("inlet").alias("inlet"), F.bool_and("confident").alias("confident"))
        members = spark.createDataFrame([(i, e) for i, (_, loop) in first.items() for e in loop], "loop int, name string")
        within = mixture.join(F.broadcast(members), "loop").select("step", "name", F.lit(None).cast("double").alias("flow"), "inlet", F.col("inlet").alias("outlet"), "confident", F.lit(None).cast("double").alias("replaced"), F.lit(None).cast("array<double>").alias("profile"), F.lit(None).cast("array<double>").alias("trust"))
        found = found.filter(~F.col("name").isin(list(connectors))).unionByName(within)
    return found, useless, lacking


#: Changes that versions() orders in one task.
MOST_CHANGES = 1_000_000


def versions(controls: DataFrame, steps: DataFrame) -> DataFrame:
    """(version, step_from, step_to, closed): runs of steps(step) between changes of controls(step, name, is_opened); closed lists what is shut then.

    A control holds from its step on. The steps of changes are ordered by one
    window over them alone; more than MOST_CHANGES are an error.
    """
    changes = controls.select("step").union(steps.agg(F.min("step").alias("step"))).distinct()
    if changes.count() > MOST_CHANGES:
        raise ValueError(f"more than {MOST_CHANGES} steps have changes")
    order = Window.orderBy("step")
    last = steps.agg(F.max("step").alias("last"))
    numbered = changes.withColumn("next", F.lead("step").over(order)).withColumn("version", F.row_number().over(order) - 1)
    runs = numbered.join(F.broadcast(last)).select("version", F.col("step").alias("step_from"), F.coalesce(F.col("next") - 1, "last").alias("step_to"))
    ends = runs.agg((F.max("version") + 1).alias("end"))
    own = Window.partitionBy("name").orderBy("version")
    states = controls.join(runs.select(F.col("step_from").alias("step"), "version"), "step").withColumn("until", F.lead("version").over(own)).join(F.broadcast(ends))
    shut = states.filter("not is_opened").select("name", F.explode(F.sequence("version", F.coalesce("until", "end") - 1)).alias("version")).groupBy("version").agg(F.array_sort(F.collect_list("name")).alias("closed"))
    return runs.join(shut, "version", "left").withColumn("closed", F.coalesce("closed", F.array().cast("array<string>")))
