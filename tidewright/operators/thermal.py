"""Non-isothermal histories of pipes: temperatures and batches of fluid carried along, viscosity by temperature, soil that warms.

A pipe's history is one task's work, and tasks hold several pipes; the kernels
are NumPy over cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalar import GRAVITY
from tidewright.operators.advection import GROUP_ROWS, fv_step, uniform_cells
from tidewright.operators.identify import Products, gauss_newton
from tidewright.operators.pipe_tasks import Pipe, frictions

#: What enters a pipe and travels with the fluid: temperature, density, and viscosity at REFERENCE kelvins with its fall per kelvin.
CARRIED = ("temperature", "density", "viscosity", "fall")
REFERENCE = 293.15


@dataclass
class Heat:
    """How a pipe gives heat: by a constant transfer coefficient, or through soil zones that store it.

    soil has rows (share of the length, a, b, c, f) of the two-part model: the
    zone's heat flow is (a + b c)(fluid - ambient) + f b (soil - ambient), and
    its soil warms by c (fluid - ambient) + f (soil - ambient) a second.
    transfer_factor is what identification adapts.
    """

    transfer: float = 2.0
    capacity: float = 2000.0
    transfer_factor: float = 1.0
    soil: tuple = ()

    def zones(self, n: int) -> np.ndarray | None:
        """Coefficients (n, 4) of cells: each has those of the zone that its middle is in."""
        if not self.soil:
            return None
        ends = np.cumsum([z[0] for z in self.soil])
        at = np.searchsorted(ends / ends[-1], (np.arange(n) + 0.5) / n, side="left")
        return np.array([z[1:] for z in self.soil], float)[np.minimum(at, len(self.soil) - 1)]


def viscosities(temperature: np.ndarray, viscosity: np.ndarray, fall: np.ndarray) -> np.ndarray:
    return viscosity * np.exp(-fall * (temperature - REFERENCE))


def gradients(pipe: Pipe, flow: float, layers: dict[str, np.ndarray]) -> np.ndarray:
    """dp/dx of each cell at its own temperature, density and viscosity."""
    v = flow / pipe.area
    lam = frictions(v * pipe.inner / viscosities(layers["temperature"], layers["viscosity"], layers["fall"]), pipe.roughness / pipe.inner)
    return -lam * pipe.friction_factor / pipe.inner * layers["density"] * v * abs(v) / 2 - layers["density"] * GRAVITY * pipe.rise / pipe.length


def exchanged(pipe: Pipe, heat: Heat, flow: float, layers: dict[str, np.ndarray], soil: np.ndarray | None, ambient: float, dt: float) -> tuple[np.ndarray, np.ndarray | None]:
    """Temperatures of fluid and soil after dt at rest in place: friction warms, the surroundings or the soil take heat."""
    v = abs(flow) / pipe.area
    t, rho = layers["temperature"], layers["density"]
    lam = frictions(v * pipe.inner / viscosities(t, layers["viscosity"], layers["fall"]), pipe.roughness / pipe.inner)
    stored = rho * heat.capacity * pipe.inner
    if soil is None:
        transfer = heat.transfer * heat.transfer_factor
        tends = ambient + lam * rho * v**3 / (8 * transfer)
        return tends + (t - tends) * np.exp(-4 * transfer * dt / stored), None
    a, b, c, f = heat.zones(len(t)).T
    taken = ((a + b * c) * (t - ambient) + f * b * (soil - ambient)) * heat.transfer_factor
    warmed = soil + dt * (c * (t - ambient) + f * (soil - ambient))
    return t + dt * (4 * taken / stored + lam * v**3 / (2 * heat.capacity * pipe.inner)), warmed


def quasistatic(history: DataFrame, pipes: DataFrame, dt: float, soil: dict | None = None, profiles: bool = False) -> DataFrame:
    """(pipe, step, flow, t_out, p_in, p_out) of history(pipe, step, flow, p_in, temperature, density, viscosity, fall, ambient).

    What enters is carried along the flow; step 0 fills the pipe with it. pipes
    has pipe, length, diameter and, if it likes, roughness, rise,
    friction_factor, transfer, capacity, transfer_factor. soil gives zones
    ((share, a, b, c, f), ...) by pipe; a soil starts as warm as its
    surroundings. profiles adds the cells' temperatures.
    """
    shape = [c for c in ("length", "diameter", "roughness", "rise", "friction_factor", "diameter_factor") if c in pipes.columns]
    warm = [c for c in ("transfer", "capacity", "transfer_factor") if c in pipes.columns]
    zones = soil or {}

    def one(rows: pd.DataFrame) -> list[tuple]:
        pipe, name = Pipe(**{c: float(rows[c].iloc[0]) for c in shape}), rows["pipe"].iloc[0]
        heat = Heat(**{c: float(rows[c].iloc[0]) for c in warm}, soil=tuple(zones.get(name, ())))
        n, cell = uniform_cells(pipe.length)
        layers = {c: np.full(n, float(rows[c].iloc[0])) for c in CARRIED}
        ground = np.full(n, float(rows["ambient"].iloc[0])) if heat.soil else None
        out = []
        for i, r in enumerate(rows.itertuples(index=False)):
            flow = float(r.flow)
            if i:
                parts = max(1, math.ceil(abs(flow) / pipe.area * dt / cell - 1e-9))
                for _ in range(parts):
                    for c in CARRIED:
                        layers[c] = fv_step(layers[c], getattr(r, c), getattr(r, c), flow / pipe.area, cell, dt / parts)
                    layers["temperature"], ground = exchanged(pipe, heat, flow, layers, ground, float(r.ambient), dt / parts)
            end = -1 if flow >= 0 else 0
            p_out = r.p_in + float(gradients(pipe, flow, layers).sum()) * pipe.length / n
            out.append((name, r.step, flow, float(layers["temperature"][end]), r.p_in, p_out, *([layers["temperature"].tolist()] if profiles else [])))
        return out

    columns = ["pipe", "step", "flow", "t_out", "p_in", "p_out"] + (["temperatures"] if profiles else [])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pipe", "step"])
        return pd.DataFrame([x for _, own in rows.groupby("pipe", sort=False) for x in one(own)], columns=columns)

    kind = history.schema["pipe"].dataType.simpleString()
    given = history.select("pipe", F.col("step").cast("long").alias("step"), *[F.col(c).cast("double").alias(c) for c in ("flow", "p_in", *CARRIED, "ambient")]).join(pipes.select("pipe", *shape, *warm), "pipe")
    counted = history.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("pipe").alias("pipes")).first()
    groups = max(1, math.ceil(counted["rows"] / GROUP_ROWS), min(counted["pipes"], 4 * int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    fields = f"pipe {kind}, step long, flow double, t_out double, p_in double, p_out double" + (", temperatures array<double>" if profiles else "")
    return given.withColumn("group", F.pmod(F.xxhash64("pipe"), F.lit(groups))).groupBy("group").applyInPandas(run, fields)


def identified(history: DataFrame, pipes: DataFrame, dt: float, what: str = "transfer_factor", seen: str = "t_out") -> tuple[float, list[float], str]:
    """(factor, sums of squares, outcome): the transfer_factor or friction_factor, one for all pipes, that brings t_out or p_out closest to history's column of that name."""
    if what not in ("transfer_factor", "friction_factor") or seen not in ("t_out", "p_out"):
        raise ValueError(f"{what} can't be identified from {seen}")
    spark = history.sparkSession
    scale = 1.0 if seen == "t_out" else 1e5

    def residuals(vectors: list[np.ndarray]) -> Products:
        factors = F.broadcast(spark.createDataFrame([(i, float(x[0])) for i, x in enumerate(vectors)], "scenario int, factor double"))  # a handful of variants
        name = F.concat_ws("/", F.col("scenario").cast("string"), F.replace(F.col("pipe").cast("string"), F.lit("/"), F.lit(" ")))
        ran = quasistatic(history.drop(seen).join(factors).withColumn("pipe", name).drop("scenario", "factor"), pipes.join(factors).withColumn("pipe", name).withColumn(what, F.col("factor")).drop("scenario", "factor"), dt)
        told = history.select("pipe", "step", F.col(seen).alias("told")).join(factors).select(name.alias("pipe"), "step", "scenario", "told")
        key = F.struct(F.substring_index("pipe", "/", -1).alias("pipe"), "step").alias("key")
        return Products.summed(ran.join(told, ["pipe", "step"]).select("scenario", key, ((F.col(seen) - F.col("told")) / scale).alias("r")), len(vectors))

    x, sums, outcome = gauss_newton(residuals, np.array([1.0]), (np.array([0.1]), np.array([10.0])))
    return float(x[0]), sums, outcome


def ramp(steps: int, first: float, last: float, since: int, until: int) -> list[float]:
    """A signal that goes evenly from first to last between two steps."""
    return [first if s <= since else last if s >= until else first + (last - first) * (s - since) / (until - since) for s in range(steps)]


def fastest_step(cell: float, velocity: float) -> float:
    """The time step at which the largest speed moves a fluid by one cell."""
    return abs(cell / velocity)
