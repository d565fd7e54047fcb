"""Histories of single pipes: quasi-stationary pressures over advected profiles, temperatures, and fast transients.

A pipe's history is one task's work, and a task steps pipes of equally many cells together; kernels are NumPy over pipes and cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalar import GRAVITY
from tidewright.operators.advection import fv_step, fv_steps, uniform_cells
from tidewright.operators.hydraulics import bracketed_root, bracketed_roots, friction
from tidewright.operators.scenarios import dealt, whole
from tidewright.storage import discarded, written


@dataclass
class Pipe:
    """What a pipe is; heights rise evenly by rise over its length. friction_factor and diameter_factor are what identification adapts."""

    length: float
    diameter: float
    roughness: float = 1.25e-4
    rise: float = 0.0
    friction_factor: float = 1.0
    diameter_factor: float = 1.0

    @property
    def inner(self) -> float:
        return self.diameter * self.diameter_factor

    @property
    def area(self) -> float:
        return math.pi * self.inner**2 / 4


def frictions(re: np.ndarray, roughness: float) -> np.ndarray:
    """hydraulics.friction() of many Reynolds numbers."""
    re = np.maximum(np.abs(re), 1e-12)
    share = 1 - np.exp(-0.002 * (re - 2320))
    passage = 64 / re * (1 - share) + 0.3164 / re**0.25 * share
    turbulent = (-1.8 * np.log10(6.8 / re + (roughness / 3.7) ** 1.1)) ** -2
    return np.where(re < 2320, 64 / np.maximum(re, 1.0), np.where(re < 4000, passage, turbulent))


def gradients(pipe: Pipe, flow: float, density: np.ndarray, viscosity: np.ndarray, reduction: np.ndarray | float = 0.0) -> np.ndarray:
    """dp/dx of each cell: friction, less what an additive takes from it, and the profile's slope. It doesn't depend on pressure."""
    v = flow / pipe.area
    lam = frictions(v * pipe.inner / np.asarray(viscosity, float), pipe.roughness / pipe.inner)
    loss = lam * pipe.friction_factor * (1 - reduction) / pipe.inner * density * v * abs(v) / 2
    return -loss - density * GRAVITY * pipe.rise / pipe.length


def outlet_pressure(pipe: Pipe, flow: float, p_in: float, density, viscosity, reduction=0.0) -> float:
    return p_in + float(gradients(pipe, flow, density, viscosity, reduction).sum()) * pipe.length / len(density)


def pressure_profile(pipe: Pipe, flow: float, p_in: float, density, viscosity, reduction=0.0) -> np.ndarray:
    """Pressures at the ends of cells, from the inlet on."""
    return p_in + np.concatenate([[0.0], np.cumsum(gradients(pipe, flow, density, viscosity, reduction))]) * pipe.length / len(density)


def flow_between(pipe: Pipe, p_in: float, p_out: float, density, viscosity, reduction=0.0) -> float:
    """The flow at which p_in falls to p_out; the outlet pressure falls with flow, so a bracket closes."""
    f = lambda q: outlet_pressure(pipe, q, p_in, density, viscosity, reduction) - p_out
    reach = 1.0
    while f(-reach) < 0 or f(reach) > 0:
        reach *= 4
    return bracketed_root(f, -reach, reach)


#: Rows of histories that are held at once, about: those of whole pipes. Cells of pipes that are stepped together, at most, if one pipe hasn't more.
HISTORY_ROWS, CELLS = 50_000, 1_000_000
PIPE_FIELDS = ("length", "diameter", "roughness", "rise", "friction_factor", "diameter_factor")
LAYERS = ("density", "viscosity", "reduction")


def _flows_between(pipes: Pipe, p_in: np.ndarray, p_out: np.ndarray, layers: dict[str, np.ndarray]) -> np.ndarray:
    """flow_between() of many pipes, a row each."""
    f = lambda q, of: _outlets(_rows_of(pipes, of), q, p_in[of], {c: v[of] for c, v in layers.items()}) - p_out[of]
    every = np.arange(len(p_in))
    reach, open_ = np.ones(len(p_in)), every
    while len(open_):
        open_ = open_[(f(-reach[open_], open_) < 0) | (f(reach[open_], open_) > 0)]
        reach[open_] *= 4
    return bracketed_roots(f, -reach, reach)


def _rows_of(pipes: Pipe, of: np.ndarray) -> Pipe:
    return Pipe(**{c: getattr(pipes, c)[of] for c in PIPE_FIELDS})


def _outlets(pipes: Pipe, flow: np.ndarray, p_in: np.ndarray, layers: dict[str, np.ndarray]) -> np.ndarray:
    """outlet_pressure() of many pipes of equally many cells, a row each."""
    return p_in + gradients(pipes, flow[:, None], *[layers[c] for c in LAYERS]).sum(1) * pipes.length[:, 0] / layers["density"].shape[1]


def histories(rows: dict[str, np.ndarray], firsts: np.ndarray, dt: float, unsteady: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(flow, p_out) of the rows of whole pipes, in order of their steps; firsts is where pipes begin.

    Pipes of equally many cells are stepped together, a row of cells each. A
    layer that is what enters stays as it is.
    """
    sizes = np.diff([*firsts, len(rows["flow"])])
    grids = [uniform_cells(x) for x in rows["length"][firsts]]
    numbers, widths = np.array([n for n, _ in grids], int), np.array([c for _, c in grids], float)
    flows, outlets = np.full(len(rows["flow"]), np.nan), np.full(len(rows["flow"]), np.nan)
    for n in np.unique(numbers):
        alike = np.flatnonzero(numbers == n)
        alike = alike[np.argsort(-sizes[alike], kind="stable")]  # those with the longest histories first, so that the live ones are a head
        most = max(1, CELLS // n)
        for own in (alike[k : k + most] for k in range(0, len(alike), most)):
            begin, size, cell = firsts[own], sizes[own], widths[own]
            pipes = Pipe(**{c: rows[c][begin][:, None] if c in rows else np.full((len(own), 1), float(getattr(Pipe, c))) for c in PIPE_FIELDS})
            layers = {c: np.repeat(rows[c][begin][:, None], n, 1) for c in LAYERS}
            flow = np.zeros(len(own))
            for k in range(int(size[0])):
                live = int((size > k).sum())
                at = begin[:live] + k
                now = _rows_of(pipes, slice(0, live))
                speed = flow[:live] / now.area[:, 0]
                if k and unsteady:
                    if np.isnan(speed).any():
                        raise ValueError("a step needs the flow of the one before")
                    parts = np.maximum(1, np.ceil(np.abs(speed) * dt / cell[:live])).astype(int)
                    for c, values in layers.items():
                        entering = rows[c][at]
                        moved = np.flatnonzero((values[:live] != entering[:, None]).any(1))
                        for j in range(int(parts[moved].max(initial=0))):
                            of = moved[parts[moved] > j]
                            values[of] = fv_steps(values[of], entering[of], entering[of], speed[of], cell[of], dt / parts[of])
                elif k:
                    for c, values in layers.items():
                        values[:live] = rows[c][at][:, None]
                inside = {c: values[:live] for c, values in layers.items()}
                flow[:live] = rows["flow"][at]
                follows = np.flatnonzero(np.isnan(flow[:live]))
                if len(follows):
                    flow[follows] = _flows_between(_rows_of(now, follows), rows["p_in"][at[follows]], rows["p_out"][at[follows]], {c: v[follows] for c, v in inside.items()})
                flows[at], outlets[at] = flow[:live], _outlets(now, flow[:live], rows["p_in"][at], inside)
    return flows, outlets


def _given(history: DataFrame, pipes: DataFrame) -> DataFrame:
    """history with what pipes are like; what may be left out has its default."""
    known = [c for c in PIPE_FIELDS if c in pipes.columns]
    given = history.join(pipes.select("pipe", *known), "pipe")
    for c in ("flow", "p_in", "p_out", *LAYERS):
        given = given.withColumn(c, F.col(c).cast("double")) if c in given.columns else given.withColumn(c, F.lit({"reduction": 0.0}.get(c)).cast("double"))
    return given.select("pipe", F.col("step").cast("long").alias("step"), "flow", "p_in", "p_out", *LAYERS, *[F.col(c).cast("double").alias(c) for c in known])


def _numbers(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: table[c].to_numpy() for c in table.column_names if c not in ("pipe", "step")}


def quasistatic(history: DataFrame, pipes: DataFrame, dt: float, unsteady: bool = True) -> DataFrame:
    """(pipe, step, flow, p_in, p_out) of history(pipe, step, flow, p_in, p_out, density, viscosity, reduction).

    Where flow is given, the outlet pressure follows; where it is null, both
    pressures are given and the flow follows. Densities, viscosities and the
    additive's reduction enter at the inlet and are advected (unsteady), or fill
    the pipe at once. pipes has pipe, length, diameter and, if it likes,
    roughness, rise, friction_factor and diameter_factor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, firsts in whole(batches, ["pipe"], HISTORY_ROWS):
            flow, p_out = histories(_numbers(table), firsts, dt, unsteady)
            found = [table[c].combine_chunks() for c in ("pipe", "step")] + [pa.array(flow, from_pandas=True), table["p_in"].combine_chunks(), pa.array(p_out, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(found, ["pipe", "step", "flow", "p_in", "p_out"])

    kind = history.schema["pipe"].dataType.simpleString()
    return dealt(_given(history, pipes), ["pipe"], ("step",)).mapInArrow(run, f"pipe {kind}, step long, flow double, p_in double, p_out double")


def identified(history: DataFrame, pipes: DataFrame, dt: float, what: str) -> tuple[float, list[float], str]:
    """(factor, sums of squares, outcome): the friction_factor or diameter_factor that brings outlet pressures closest to history's p_out.

    What is run is written once. A round is one job: a pipe's variants are run
    where the pipe is, and tasks hand on the products of their residuals.
    """
    from tidewright.operators.identify import Products, gauss_newton

    if what not in ("friction_factor", "diameter_factor"):
        raise ValueError(f"{what} can't be identified")
    given = written(_given(history, pipes), "identified")

    def residuals(vectors: list[np.ndarray]) -> Products:
        factors = [float(x[0]) for x in vectors]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, firsts in whole(batches, ["pipe"], HISTORY_ROWS):
                rows = _numbers(table)
                off = [(histories(rows | {what: np.full(table.num_rows, x)}, firsts, dt)[1] - rows["p_out"]) / 1e5 for x in factors]
                r = np.nan_to_num(np.stack(off), nan=0.0)
                i, j = np.indices((len(factors), len(factors)))
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array((r @ r.T).ravel())], ["i", "j", "s"])

        sums = dealt(given, ["pipe"], ("step",)).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
        matrix = np.zeros((len(factors), len(factors)))
        for row in sums:
            matrix[row["i"], row["j"]] = row["s"]
        return Products(matrix)

    x, history_of, outcome = gauss_newton(residuals, np.array([1.0]), (np.array([0.2]), np.array([5.0])))
    discarded(given)
    return float(x[0]), history_of, outcome


def temperature_step(values: np.ndarray, inlet: float, flow: float, pipe: Pipe, cell: float, dt: float, ambient: float, transfer: float, density: float = 850.0, capacity: float = 2000.0, viscosity: float = 1e-5) -> np.ndarray:
    """Temperatures of cells after dt: advection, heat given to the surroundings and heat of friction."""
    v = flow / pipe.area
    moved = fv_step(values, inlet, inlet, v, cell, dt)
    lam = friction(v * pipe.inner / viscosity, pipe.roughness / pipe.inner)
    tends = ambient + lam * density * abs(v) ** 3 / (8 * transfer)
    return tends + (moved - tends) * math.exp(-4 * transfer * dt / (density * capacity * pipe.inner))


def transient_step(p: np.ndarray, v: np.ndarray, density: float, sound: float, friction_slope, left: tuple[str, float], right: tuple[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Pressures and velocities at points after the time sound takes from one to the next, along both characteristics.

    friction_slope(v) is the pressure that friction takes between two points.
    An end is given as ("p", pressure) or ("v", velocity).
    """
    z = density * sound
    plus = p[:-1] + z * v[:-1] - friction_slope(v[:-1])
    minus = p[1:] - z * v[1:] + friction_slope(v[1:])
    new_p, new_v = np.empty_like(p), np.empty_like(v)
    new_p[1:-1], new_v[1:-1] = (plus[:-1] + minus[1:]) / 2, (plus[:-1] - minus[1:]) / (2 * z)
    for end, (kind, value), wave, sign in ((0, left, minus[0], 1), (-1, right, plus[-1], -1)):
        if kind == "p":
            new_p[end], new_v[end] = value, sign * (value - wave) / z
        else:
            new_p[end], new_v[end] = wave + sign * z * value, value
    return new_p, new_v


def trimmed_step(x: np.ndarray, step: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None, relative: np.ndarray | None = None) -> np.ndarray:
    """step shortened as a whole so that no part moves by more than relative, then cut where x + step would leave [low, high]."""
    if relative is not None:
        over = np.abs(step) / relative
        step = step / max(1.0, float(over.max()))
    to = x + step
    if low is not None:
        to = np.maximum(to, low)
    if high is not None:
        to = np.minimum(to, high)
    return to - x
