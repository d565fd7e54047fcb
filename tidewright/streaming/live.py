"""Live forms of the batch operators, by Structured Streaming.

The advection state of a pipe is its cells; the step function is that of the
batch operator, so both modes give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.functions.scalar import CONFIDENT
from tidewright.operators.advection import fv_step, uniform_cells


def balances(readings: DataFrame, step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(t, network, residual, n) of readings(ts, network, sign, value) by windows of event time; readings later than late are dropped."""
    return readings.withWatermark("ts", late).groupBy(F.window("ts", step), "network").agg(F.sum(F.col("sign") * F.col("value")).alias("residual"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("t"), "network", "residual", "n")


def switchings(readings: DataFrame, threshold: float) -> DataFrame:
    """(tag, ts, is_zeroflow) whenever a tag of readings(tag, ts, value) comes to rest or sets off, its first state included."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("ts")
        was = state.get[0] if state.exists else None
        out = []
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            now = bool(abs(value) < threshold)
            if was is None or now != was:
                out.append((key[0], ts, now))
            was = now
        state.update((was,))
        yield pd.DataFrame(out, columns=["tag", "ts", "is_zeroflow"])

    tag = readings.schema["tag"].dataType.simpleString()
    ts = readings.schema["ts"].dataType.simpleString()
    return readings.groupBy("tag").applyInPandasWithState(run, f"tag {tag}, ts {ts}, is_zeroflow boolean", "was boolean", "append", GroupStateTimeout.NoTimeout)


def advected(inlets: DataFrame, dt: float, initial: float) -> DataFrame:
    """(pipe, step, inlet, outlet, confident) for a stream inlets(pipe, length, diameter, step, flow, value, confident), whose steps come in order."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("step")
        n, cell = uniform_cells(float(rows["length"].iloc[0]))
        area = math.pi * float(rows["diameter"].iloc[0]) ** 2 / 4
        if state.exists:
            values, trust, last, sure, at = state.get
            values, trust = np.array(values), np.array(trust)
        else:
            values, trust, last, sure, at = np.full(n, initial), np.zeros(n), initial, 0.0, -1
        out = []
        for step, flow, value, confident in zip(rows["step"], rows["flow"], rows["value"], rows["confident"], strict=True):
            if step <= at:
                raise ValueError(f"step {step} of pipe {key[0]} comes after step {at}")
            if not pd.isna(value):
                last, sure = float(value), float(bool(confident))
            velocity = 0.0 if pd.isna(flow) else float(flow) / area
            if at < 0:
                values = np.full(n, last)
            else:
                values, trust = fv_step(values, last, last, velocity, cell, dt), fv_step(trust, sure, sure, velocity, cell, dt)
            at = int(step)
            end = -1 if velocity >= 0 else 0
            out.append((key[0], at, last, float(values[end]), bool(trust[end] > CONFIDENT)))
        state.update((values.tolist(), trust.tolist(), last, sure, at))
        yield pd.DataFrame(out, columns=["pipe", "step", "inlet", "outlet", "confident"])

    pipe = inlets.schema["pipe"].dataType.simpleString()
    return inlets.groupBy("pipe").applyInPandasWithState(
        run, f"pipe {pipe}, step long, inlet double, outlet double, confident boolean", "cells array<double>, trust array<double>, last double, sure double, at long", "append", GroupStateTimeout.NoTimeout
    )
