"""The ways for large inputs give what the plain ways give."""

import math

import numpy as np
import pandas as pd
import pytest

from tidewright.operators import advection, graph, series


@pytest.fixture
def net(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (55, 2))] + [(100 + i, 101 + i) for i in range(20)] + [(5, None), (None, 7)]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge long, from_v long, to_v long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_parts_and_hops_of_networks(spark, net):
    starts = spark.createDataFrame([(100,), (5,)], "vertex long")
    near = {}
    for _, a, b in net.collect():
        for v in (a, b):
            if v is not None:
                near.setdefault(v, set())
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    part, rank = {}, {100: (0, None), 5: (0, None)}
    for root in sorted(near):
        todo = [root]
        while todo:
            v = todo.pop()
            if v not in part:
                part[v] = root
                todo += near[v]
    front = [100, 5]
    while front:
        fresh = {}
        for v in front:
            for w in near[v]:
                if w not in rank:
                    fresh[w] = min(fresh.get(w, v), v)
        rank |= {w: (rank[v][0] + 1, v) for w, v in fresh.items()}
        front = list(fresh)
    assert {r["vertex"]: r["component"] for r in graph.components(net).collect()} == part
    assert {r["vertex"]: (r["rank"], r["before"]) for r in graph.hops(net, starts).collect()} == rank


def one_pipe(history, length, diameter, dt, initial, substeps, state=None):
    n, cell = advection.uniform_cells(length)
    area = math.pi * diameter**2 / 4
    values, trust, last, sure = np.full(n, initial), np.zeros(n), initial, 0.0
    if state:
        values, trust, last = np.array(state[0]), np.array(state[1]), state[2]
    out = []
    for k, (step, flow, value, confident) in enumerate(history):
        if value is not None:
            last, sure = value, float(bool(confident))
        if k == 0 and not state:
            values = np.full(n, last)
        else:
            v = (flow or 0.0) / area
            parts = max(1, math.ceil(abs(v) * dt / cell)) if substeps else 1
            for _ in range(parts):
                values = advection.fv_step(values, last, last, v, cell, dt / parts)
                trust = advection.fv_step(trust, sure, sure, v, cell, dt / parts)
        end = -1 if (flow or 0.0) >= 0 else 0
        out.append((step, last, values[end], bool(trust[end] > 0.95), values, trust))
    return out


@pytest.mark.parametrize("substeps", [False, True])
def test_pipes_stepped_together_go_as_each_alone(spark, substeps):
    rng = np.random.default_rng(9)
    lengths = {p: float(rng.choice([150.0, 900.0, 1000.0, 2300.0])) for p in range(12)}
    most = 3.0 if substeps else 0.6
    histories = {p: [(s, float(rng.uniform(-most, most)) if rng.random() > 0.1 else None, float(rng.uniform(800, 900)) if rng.random() > 0.2 else None, bool(rng.random() > 0.5)) for s in range(int(rng.integers(1, 40)))] for p in lengths}
    inlets = spark.createDataFrame([(p, *r) for p, h in histories.items() for r in h], "pipe long, step long, flow double, value double, confident boolean").repartition(4)
    pipes = spark.createDataFrame([(p, x, 0.5) for p, x in lengths.items()], "pipe long, length double, diameter double")
    whole = {(r["pipe"], r["step"]): r for r in advection.advected(inlets, pipes, 60.0, 860.0, substeps=substeps, profiles=True).collect()}
    for p, h in histories.items():
        for step, inlet, outlet, confident, values, trust in one_pipe(h, lengths[p], 0.5, 60.0, 860.0, substeps):
            r = whole[p, step]
            assert r["inlet"] == inlet and math.isclose(r["outlet"], outlet, rel_tol=1e-12) and r["confident"] == confident
            assert np.allclose(r["profile"], values, rtol=1e-12) and np.allclose(r["trust"], trust, atol=1e-12)
    half = 15
    early = advection.advected(inlets.filter(f"step < {half}"), pipes, 60.0, 860.0, substeps=substeps, profiles=True)
    ends = early.groupBy("pipe").agg(*[__import__("pyspark.sql.functions", fromlist=["max_by"]).max_by(c, "step").alias(c) for c in ("profile", "trust", "inlet")])
    late = advection.advected(inlets.filter(f"step >= {half}"), pipes, 60.0, 860.0, substeps=substeps, profiles=True, states=ends)
    for r in late.collect():
        assert np.allclose(r["profile"], whole[r["pipe"], r["step"]]["profile"], rtol=1e-12)


def test_a_courant_number_above_one_is_an_error(spark):
    inlets = spark.createDataFrame([(1, s, 9.0, 800.0, True) for s in range(3)], "pipe long, step long, flow double, value double, confident boolean")
    pipes = spark.createDataFrame([(1, 1000.0, 0.5)], "pipe long, length double, diameter double")
    with pytest.raises(Exception, match="Courant"):
        advection.advected(inlets, pipes, 60.0, 860.0).collect()


@pytest.mark.parametrize("alpha", [1.0, 0.9, 1 / 3, 0.01])
def test_smoothing_by_parts(spark, alpha):
    rng = np.random.default_rng(2)
    data = [(t, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=int(s)), float(v)) for t in (1, 2) for s, v in zip(np.sort(rng.choice(400_000, 1500, replace=False)), rng.normal(50, 20, 1500), strict=True)]
    frame = spark.createDataFrame([(t, ts.to_pydatetime(), v) for t, ts, v in data], "tag long, ts timestamp, value double")
    got = {(r["tag"], r["ts"]): r["smooth"] for r in series.smoothed(frame, alpha).collect()}
    last = {}
    for t, ts, v in data:
        last[t] = alpha * v + (1 - alpha) * last[t] if t in last else v
        assert math.isclose(got[t, ts.to_pydatetime()], last[t], rel_tol=1e-9, abs_tol=1e-9)


def test_grid_of_many_steps(spark):
    bounds = spark.sql("select timestamp'2024-01-01 00:00:00' as t_start, timestamp'2024-01-01 01:00:00.5' as t_end")
    got = [tuple(r) for r in series.grid(bounds, 60).orderBy("step").collect()]
    assert len(got) == 61 and got[-1][0] == 60 and str(got[-1][1]) == "2024-01-01 01:00:00"
    assert series.grid(spark.sql("select timestamp'2024-01-01' as t_start, timestamp'2024-01-01' as t_end"), 60).count() == 0
    assert series.grid(spark.sql("select cast(null as timestamp) as t_start, cast(null as timestamp) as t_end"), 60).count() == 0


def test_rows_before_and_means_across_slices_and_pieces(spark):
    rng = np.random.default_rng(6)
    data = {t: [(pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=int(s)), float(v)) for s, v in zip(np.sort(rng.choice(2_000_000, n, replace=False)), rng.uniform(0, 100, n), strict=True)] for t, n in ((1, 300), (2, 1), (3, 40))}
    frame = spark.createDataFrame([(t, ts.to_pydatetime(), v) for t, h in data.items() for ts, v in h], "tag long, ts timestamp, value double").repartition(3)
    clean, turns, means = {}, {}, {}
    for t, h in data.items():
        inside = [x for x in h if 5 <= x[1] <= 95]
        clean |= {(t, ts): v for i, (ts, v) in enumerate(inside) if i == 0 or abs(v - inside[i - 1][1]) <= 40}
        turns |= {(t, ts): v < 25 for i, (ts, v) in enumerate(h) if i == 0 or (v < 25) != (h[i - 1][1] < 25)}
        means |= {(t, ts): float(np.mean([x for _, x in h[i - 3 : i + 4]])) if 3 <= i < len(h) - 3 else None for i, (ts, _) in enumerate(h)}
    assert {(r["tag"], pd.Timestamp(r["ts"])): r["value"] for r in series.cleaned(frame, 5.0, 95.0, 40.0).collect()} == clean
    assert {(r["tag"], pd.Timestamp(r["ts"])): r["is_zeroflow"] for r in series.switchings(frame, 25.0).collect()} == turns
    for piece in (8, 50, 100_000):
        got = {(r["tag"], pd.Timestamp(r["ts"])): r["mean"] for r in series.centred_mean(frame, 7, piece).collect()}
        assert set(got) == set(means) and all(got[k] == pytest.approx(means[k]) if means[k] is not None else got[k] is None for k in means)
    with pytest.raises(ValueError):
        series.centred_mean(frame, 7, 7)
