"""Batches of whole networks over time: scenarios are the parallel axis, steps go in order within each.

A network's description is small and travels with the function; histories of
controls and measurements are rows. Each scenario has an engine of its own, or,
for stored layers, each layer has.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.engine import STEP_SECONDS, Engine
from tidewright.operators import hydraulics
from tidewright.operators.scenarios import dealt, whole

#: What a batch does at each step: steady solves, or solves with densities carried along (the first step is a solve alone).
HYDRO, COUPLED = "hydro", "coupled"
FIELDS = "step long, place_kind string, place string, pressure double, flow double, converged boolean"


def _rows(engine: Engine, step: int, converged: bool) -> list[tuple]:
    flows = [(step, "edge", name, None, q, converged) for name, q in engine.flows.items()]
    return [(step, "vertex", str(v), p, None, converged) for v, p in engine.pressures.items()] + flows


def _stepped(engine: Engine, history: pd.DataFrame, mode: str, dt: float) -> Iterator[tuple[int, bool]]:
    """Steps in order, with the engine as it is after each."""
    for i, r in enumerate(history.sort_values("step").itertuples(index=False)):
        given = r.controls if isinstance(r.controls, str) and r.controls else "{}"
        if mode == HYDRO or i == 0:
            yield int(r.step), engine.solve(given)
        else:
            yield int(r.step), engine.step(dt, given)


#: Steps that are held at once, about: those of whole scenarios.
STEPS = 50_000


def run(history: DataFrame, topology: str, objects: str, mode: str = HYDRO, dt: float = STEP_SECONDS, scenario: str = "scenario", sink: Callable[[Engine, int], None] | None = None) -> DataFrame:
    """(scenario, step, place_kind, place, pressure, flow, converged) of history(scenario, step, controls).

    controls is JSON as Engine.control() takes it, null where nothing changes;
    what isn't named stays as it was. A step whose solve fails to converge is
    told so and the scenario goes on. sink is called with the engine after each
    step, on the executor. A task holds some thousand steps of whole scenarios;
    their first steps are solved together, then their second ones, and so on.
    """
    if mode not in (HYDRO, COUPLED):
        raise ValueError(f"unknown mode {mode}")

    def layer(of: pa.Array, steps: np.ndarray, places: list, kind: str, values: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
        n, rows = len(places), len(steps) * len(places)
        found, none = pa.array(values.ravel(), from_pandas=True), pa.nulls(rows, pa.float64())
        named = pa.array([str(p) for p in places]).take(pa.array(np.tile(np.arange(n), len(steps))))
        by_step = pa.array(np.repeat(np.arange(len(steps)), n))
        columns = [of.take(by_step), pa.array(np.repeat(steps, n)), pa.repeat(kind, rows), named, found if kind == "vertex" else none, none if kind == "vertex" else found, pa.array(np.repeat(sure, n))]
        return pa.RecordBatch.from_arrays(columns, [scenario, "step", "place_kind", "place", "pressure", "flow", "converged"])

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, firsts in whole(batches, [scenario], STEPS):
            names, steps, told = table[scenario].combine_chunks(), table["step"].to_numpy(), table["controls"].to_pylist()
            sizes = np.diff([*firsts, len(steps)])
            engines = [Engine.from_json(topology, objects) for _ in firsts]
            for k in range(sizes.max()):
                live = np.flatnonzero(sizes > k)
                at = firsts[live] + k
                own = [engines[i] for i in live]
                for e, row in zip(own, at.tolist(), strict=True):
                    if told[row]:
                        e.control(told[row])
                for s in hydraulics.solve_networks([list(e.edges.values()) for e in own], [e.known() for e in own]):
                    unknown = np.isnan(s.pressures).any()
                    for i, p, q in zip(s.which, s.pressures.tolist(), s.flows.tolist(), strict=True):
                        e = own[i]
                        e.pressures = dict(zip(s.vertices, [None if v != v else v for v in p] if unknown else p, strict=True))
                        e.flows = dict(zip(s.edges, q, strict=True))
                        e.filled()
                        if mode == COUPLED and k:
                            e.carry(dt)
                        if sink:
                            sink(e, int(steps[at[i]]))
                    rows = at[s.which]
                    yield layer(names.take(pa.array(rows)), steps[rows], s.vertices, "vertex", s.pressures, s.converged)
                    yield layer(names.take(pa.array(rows)), steps[rows], s.edges, "edge", s.flows, s.converged)

    kind = history.schema[scenario].dataType.simpleString()
    given = history.select(scenario, F.col("step").cast("long").alias("step"), F.col("controls").cast("string").alias("controls"))
    return dealt(given, [scenario], ("step",)).mapInArrow(many, f"{scenario} {kind}, {FIELDS}")


def serialised(history: DataFrame, topology: str, objects: str, every_seconds: float, mode: str = COUPLED, dt: float = STEP_SECONDS, scenario: str = "scenario") -> DataFrame:
    """(scenario, step, layer, state): results and the whole state as JSON at the steps whose model time is a multiple of every_seconds."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        engine, out = Engine.from_json(topology, objects), []
        for step, _ in _stepped(engine, rows, mode, dt):
            if math.fmod(step * dt + 1e-5, every_seconds) < 1e-4:
                out.append((step, engine.results(), engine.state()))
        table = pd.DataFrame(out, columns=["step", "layer", "state"])
        table.insert(0, scenario, rows[scenario].iloc[0])
        return table

    kind = history.schema[scenario].dataType.simpleString()
    return history.select(scenario, F.col("step").cast("long").alias("step"), "controls").groupBy(scenario).applyInPandas(one, f"{scenario} {kind}, step long, layer string, state string")


def quasi_stationary(layers: DataFrame, topology: str, objects: str, scenario: str = "scenario") -> DataFrame:
    """run()'s rows for each of layers(scenario, step, state, controls): the state is restored and solved; layers don't depend on each other."""

    def many(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                engine = Engine.from_json(topology, objects)
                engine.restore(r.state)
                for name, cells in engine.cells.items():
                    engine.edges[name]["params"]["density"] = float(cells.mean())
                fine = engine.solve(r.controls if isinstance(r.controls, str) and r.controls else "{}")
                out += [(getattr(r, scenario), *row) for row in _rows(engine, int(r.step), fine)]
            yield pd.DataFrame(out, columns=[scenario, "step", "place_kind", "place", "pressure", "flow", "converged"])

    kind = layers.schema[scenario].dataType.simpleString()
    return layers.select(scenario, F.col("step").cast("long").alias("step"), "state", "controls").mapInPandas(many, f"{scenario} {kind}, {FIELDS}")


def constant(layer: DataFrame, steps: int) -> DataFrame:
    """layer's rows at each of so many steps."""
    return layer.crossJoin(layer.sparkSession.range(steps).select(F.col("id").alias("step")))  # each row at each step is what is asked for


def controls_json(rows: DataFrame, kind: str, values: dict[str, str], keys: list[str]) -> DataFrame:
    """(keys, controls): rows(keys, name, ...) as JSON of one kind of object, with values naming what each column is called there."""
    one = F.struct(*[F.col(c).alias(n) for c, n in values.items()])
    by_name = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", one.alias("o")))))
    return rows.groupBy(*keys).agg(F.to_json(F.create_map(F.lit("controls"), F.create_map(F.lit(kind), by_name))).alias("controls"))


def calendar(start: str, step_seconds: float, step: str) -> Column:
    """The calendar time of a step: so many seconds after start, to the nearest one, halves up."""
    seconds = F.floor(F.col(step) * F.lit(float(step_seconds)) + 0.5)
    return F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + seconds * 1_000_000)


def describe(topology: dict, objects: dict) -> tuple[str, str]:
    return json.dumps(topology), json.dumps(objects)
