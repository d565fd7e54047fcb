"""Transport of properties along pipes: finite-volume steps over NumPy cells, one ordered group for each pipe.

Time is sequential within a pipe only, so pipes are the parallel axis. Values
and their confidence are advected alike; confidence is read as above 0.95.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalar import CONFIDENT

CELL_METRES = 200.0


def uniform_cells(length: float, least: float = CELL_METRES) -> tuple[int, float]:
    """Number and length of the equal cells of a pipe, each at least least metres; a shorter pipe is one cell of that length."""
    n = max(1, int(length / least))
    return n, max(least, length / n)


def upstream_faces(left, centre, right, courant):
    return centre


def quick_faces(left, centre, right, courant):
    """Quadratic upstream interpolation."""
    return (centre + right) / 2 - (left + right - 2 * centre) / 8


def quickest_faces(left, centre, right, courant):
    """quick_faces with the terms of the time step."""
    return (centre + right) / 2 - courant * (right - centre) / 2 - (1 - courant**2) / 6 * (left + right - 2 * centre)


def ultimate_faces(left, centre, right, courant):
    """quickest_faces kept between the cell and what the universal limiter allows; the cell itself where the profile isn't monotone."""
    rise = right - left
    free = quickest_faces(left, centre, right, courant)
    reference = left + (centre - left) / np.maximum(courant, 1e-300)
    up = np.clip(free, centre, np.maximum(centre, np.minimum(reference, right)))
    down = np.clip(free, np.minimum(centre, np.maximum(reference, right)), centre)
    return np.where(np.abs(left + right - 2 * centre) >= np.abs(rise), centre, np.where(rise > 0, up, down))


def fv_step(cells: np.ndarray, inlet: float, outlet: float, velocity: float, cell: float, dt: float, faces: Callable = ultimate_faces) -> np.ndarray:
    """Cells after dt; inlet is what comes in at the start (velocity >= 0), outlet at the end (velocity < 0)."""
    if velocity < 0:
        return fv_step(cells[::-1], outlet, inlet, -velocity, cell, dt, faces)[::-1]
    courant = velocity * dt / cell
    if courant > 1 + 1e-12:
        raise ValueError(f"the Courant number is {courant:.3f}, above 1")
    at = np.concatenate([[inlet], cells])
    if len(cells) > 2:
        at[2:-1] = faces(cells[:-2], cells[1:-1], cells[2:], courant)
    return cells + courant * (at[:-1] - at[1:])


def moc_step(points: np.ndarray, inlet: float, velocity: float, cell: float, dt: float) -> np.ndarray:
    """Values at points along the characteristics, linear between points; an exact shift at a Courant number of 1."""
    if velocity < 0:
        return moc_step(points[::-1], inlet, -velocity, cell, dt)[::-1]
    courant = velocity * dt / cell
    if courant > 1 + 1e-12:
        raise ValueError(f"the Courant number is {courant:.3f}, above 1")
    moved = points.copy()
    moved[1:] = courant * points[:-1] + (1 - courant) * points[1:]
    moved[0] = inlet
    return moved


def ideal_step(cell: float, diameter: float, largest_flow: float) -> float:
    """The time step of a Courant number of 1."""
    return cell * math.pi * diameter**2 / 4 / abs(largest_flow)


def fv_steps(cells: np.ndarray, inlet: np.ndarray, outlet: np.ndarray, velocity: np.ndarray, cell: np.ndarray, dt: np.ndarray, faces: Callable = ultimate_faces) -> np.ndarray:
    """fv_step() of many pipes of equally many cells at once, a row each; every pipe has its own velocity, cells and time step."""
    back = velocity < 0
    rows = np.where(back[:, None], cells[:, ::-1], cells)
    courant = (np.abs(velocity) * dt / cell)[:, None]
    if (courant > 1 + 1e-12).any():
        raise ValueError(f"the Courant number is {courant.max():.3f}, above 1")
    at = np.concatenate([np.where(back, outlet, inlet)[:, None], rows], 1)
    if rows.shape[1] > 2:
        at[:, 2:-1] = faces(rows[:, :-2], rows[:, 1:-1], rows[:, 2:], courant)
    rows = rows + courant * (at[:, :-1] - at[:, 1:])
    return np.where(back[:, None], rows[:, ::-1], rows)


#: Rows of histories that one task holds, about; pipes of equally many cells are stepped together up to it.
GROUP_ROWS = 1_000_000


def advected(inlets: DataFrame, pipes: DataFrame, dt: float, initial: float, substeps: bool = False, profiles: bool | str = False, states: DataFrame | None = None) -> DataFrame:
    """(pipe, step, inlet, outlet, confident) for inlets(pipe, step, flow, value, confident) of pipes(pipe, length, diameter).

    Step 0 fills the pipe with its inlet's value, or with initial if it has
    none; confidence starts at 0. A null value is what came before. With
    substeps, a step above a Courant number of 1 is cut into equal parts;
    otherwise it is an error. profiles adds the cells and their trust, or, if it
    is "last", those of each pipe's last step, and null before. Pipes with a row in states(pipe, profile, trust, inlet) go on from there instead.

    A pipe's history is one task's work. Pipes of equally many cells share a
    task as far as GROUP_ROWS allows, and are stepped together.
    """
    kind = inlets.schema["pipe"].dataType.simpleString()
    fields = {"pipe": kind, "step": "long", "inlet": "double", "outlet": "double", "confident": "boolean"} | ({"profile": "array<double>", "trust": "array<double>"} if profiles else {})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pipe", "step"]).reset_index(drop=True)
        first = np.flatnonzero(np.concatenate([[True], (rows["pipe"].to_numpy()[1:] != rows["pipe"].to_numpy()[:-1])]))
        size = np.diff(np.concatenate([first, [len(rows)]]))
        order = np.argsort(-size, kind="stable")  # those with the longest histories first, so that the live ones are a head
        first, size = first[order], size[order]
        flow, value = rows["flow"].to_numpy(float), rows["value"].to_numpy(float)
        sure_of = rows["confident"].fillna(False).to_numpy(bool).astype(float)
        n, cell = zip(*[uniform_cells(x) for x in rows["length"].to_numpy(float)[first]], strict=True)
        n, cell = n[0], np.array(cell)
        area = math.pi * rows["diameter"].to_numpy(float)[first] ** 2 / 4
        cells, trust = np.full((len(first), n), initial), np.zeros((len(first), n))
        last, sure, held = np.full(len(first), initial), np.zeros(len(first)), np.zeros(len(first), bool)
        if "profile" in rows:
            for i, at in enumerate(first):
                if rows["profile"].iloc[at] is not None:
                    cells[i], trust[i], last[i], held[i] = rows["profile"].iloc[at], rows["trust"].iloc[at], rows["since"].iloc[at], True
        out = {"inlet": np.empty(len(rows)), "outlet": np.empty(len(rows)), "confident": np.empty(len(rows), bool)}
        kept: list = [None] * len(rows) if profiles else []
        trusted: list = [None] * len(rows) if profiles else []
        for k in range(int(size[0])):
            live = int((size > k).sum())
            at = first[:live] + k
            there = ~np.isnan(value[at])
            last[:live][there], sure[:live][there] = value[at][there], sure_of[at][there]
            moving = np.nan_to_num(flow[at]) / area[:live]
            if k == 0:
                fresh = ~held[:live]
                cells[:live][fresh] = last[:live][fresh, None]
                moving = np.where(fresh, 0.0, moving)
            parts = np.maximum(1, np.ceil(np.abs(moving) * dt / cell[:live])).astype(int) if substeps else np.ones(live, int)
            for j in range(int(parts.max())):
                now = np.flatnonzero((parts > j) & (moving != 0))
                if len(now):
                    step = dt / parts[now]
                    cells[now] = fv_steps(cells[now], last[now], last[now], moving[now], cell[now], step)
                    trust[now] = fv_steps(trust[now], sure[now], sure[now], moving[now], cell[now], step)
            end = np.where(np.nan_to_num(flow[at]) >= 0, n - 1, 0)
            out["inlet"][at], out["outlet"][at], out["confident"][at] = last[:live], cells[np.arange(live), end], trust[np.arange(live), end] > CONFIDENT
            if profiles:
                for i, row in enumerate(at):
                    if profiles == "last" and k < size[i] - 1:
                        continue
                    kept[row], trusted[row] = cells[i].tolist(), trust[i].tolist()
        if profiles:
            out |= {"profile": kept, "trust": trusted}
        return pd.DataFrame({"pipe": rows["pipe"], "step": rows["step"], **out})[list(fields)]

    told = pipes.select("pipe", "length", "diameter", F.greatest(F.lit(1), F.floor(F.col("length") / CELL_METRES)).alias("cells"))
    given = inlets.join(told, "pipe").select("pipe", F.col("step").cast("long").alias("step"), "flow", "value", "confident", "length", "diameter", "cells")
    if states is not None:
        given = given.join(states.select("pipe", "profile", "trust", F.col("inlet").alias("since")), "pipe", "left")
    counted = inlets.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("pipe").alias("pipes")).first()
    groups = max(1, math.ceil(counted["rows"] / GROUP_ROWS), min(counted["pipes"], int(inlets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    grouped = given.withColumn("group", F.pmod(F.xxhash64("pipe"), F.lit(groups)))
    return grouped.groupBy("cells", "group").applyInPandas(run, ", ".join(f"{k} {v}" for k, v in fields.items()))


def diffused(inlet: DataFrame, length: float, velocity: float, mixing: float, dt: float, steps: int) -> DataFrame:
    """(step, value) at the end of a pipe for inlet(step, value): the convolution with the arrival times of a mixing front.

    Each inlet step reaches the outlet steps within reach of the front only, so
    the rows made are a band, not all pairs.
    """
    arrival = length / velocity
    spread = math.sqrt(2 * mixing * arrival) / velocity
    lags = range(max(0, int((arrival - 6 * spread) / dt)), int((arrival + 6 * spread) / dt) + 2)

    def front(t: float) -> float:
        return 0.5 * math.erfc((length - velocity * t) / (2 * math.sqrt(mixing * t))) if t > 0 else 0.0

    weights = [(k, front((k + 1) * dt) - front(k * dt)) for k in lags]
    table = inlet.sparkSession.createDataFrame(weights, "lag int, weight double")
    spreaded = inlet.join(F.broadcast(table)).withColumn("step", F.col("step") + F.col("lag")).filter(F.col("step") < steps)  # a kernel of fixed length
    return spreaded.groupBy("step").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))
