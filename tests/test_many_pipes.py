"""Pipes that are stepped together have the pressures of those that are stepped alone."""

import math

import numpy as np
import pytest

from tidewright.operators import advection
from tidewright.operators import pipe_tasks as pt


def alone(pipe, steps, dt, unsteady):
    n, cell = advection.uniform_cells(pipe.length)
    layers, flow, out = {c: np.full(n, steps[0][c]) for c in pt.LAYERS}, 0.0, []
    for i, s in enumerate(steps):
        parts = max(1, math.ceil(abs(flow) / pipe.area * dt / cell))
        for c in pt.LAYERS:
            if i and unsteady:
                for _ in range(parts):
                    layers[c] = advection.fv_step(layers[c], s[c], s[c], flow / pipe.area, cell, dt / parts)
            elif i:
                layers[c] = np.full(n, s[c])
        flow = pt.flow_between(pipe, s["p_in"], s["p_out"], *layers.values()) if math.isnan(s["flow"]) else s["flow"]
        out.append((flow, pt.outlet_pressure(pipe, flow, s["p_in"], *layers.values())))
    return out


@pytest.mark.parametrize("unsteady", [True, False])
def test_together_as_alone(monkeypatch, unsteady):
    rng = np.random.default_rng(4)
    pipes, rows, firsts = [], [], []
    for k in range(40):
        pipes.append(pt.Pipe([150.0, 900.0, 1000.0, 4321.0][k % 4] + (k % 3), 0.5 + 0.01 * k, rise=float(k % 5), friction_factor=1 + 0.02 * k, diameter_factor=1 - 0.001 * k))
        firsts.append(len(rows))
        for _ in range(1 + k % 6):
            known = rng.random() < 0.7
            rows.append(dict(flow=float(rng.normal(0.2, 0.3)) if known else math.nan, p_in=5e6, p_out=math.nan if known else 5e6 - float(rng.normal(0, 2e5)), density=850.0 + float(rng.integers(0, 2)) * 20, viscosity=1e-5, reduction=0.1 * (k % 2), **vars(pipes[-1])))
    columns = {c: np.array([r[c] for r in rows]) for c in rows[0]}
    want = [x for k, p in enumerate(pipes) for x in alone(p, rows[firsts[k] : ([*firsts, len(rows)])[k + 1]], 300.0, unsteady)]
    for most in (pt.CELLS, 50):
        monkeypatch.setattr(pt, "CELLS", most)
        flow, p_out = pt.histories(columns, np.array(firsts), 300.0, unsteady)
        assert flow == pytest.approx([q for q, _ in want], rel=1e-9, abs=1e-9) and p_out == pytest.approx([p for _, p in want], rel=1e-9)


def test_what_is_identified_is_run_once(spark):
    """However many rounds it takes, the history's own plan runs only to be written."""
    calls = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            calls.add(len(r))
            yield r

    history = spark.createDataFrame([(f"p/{p}", s, 0.3, 6e6, 5.9e6 + 1e3 * p, 850.0, 1e-5) for p in range(3) for s in range(4)], "pipe string, step long, flow double, p_in double, p_out double, density double, viscosity double")
    pipes = spark.createDataFrame([(f"p/{p}", 3000.0 + 500 * p, 0.5) for p in range(3)], "pipe string, length double, diameter double")
    factor, sums, outcome = pt.identified(history.mapInPandas(counted, history.schema), pipes, 60.0, "friction_factor")
    assert outcome == "converged" and len(sums) > 2 and sums[-1] < sums[0] and calls.value == 12
