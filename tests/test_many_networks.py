"""Networks that are solved together have the results of those that are solved alone."""

import copy
import math

import numpy as np
import pyarrow as pa
import pytest

from tidewright.operators import hydraulics, scenarios


def edge(i, a, b, kind=None, pressure=None, flow=None, **params):
    return {"edge": i, "from_v": a, "to_v": b, "kind": kind or "source", "params": params, "pressure": pressure, "flow": flow}


def network(i):
    """Supplies, pumps of all sorts, a pipe and gates, some of which are shut; what isn't supplied rests."""
    pump = [dict(head_0=240.0, head_1=-0.02), dict(head_0=150.0, head_1=0.01, head_2=-1e-5), dict(head=200.0, fall=40.0), dict(head_0=240.0, head_1=-0.02, is_started=False)][i % 4]
    return [
        edge("a", None, 0, pressure=1e5 + 1e4 * (i % 7)), edge("p", 0, 1, "pump", density=850.0, frequency=1 - 0.01 * (i % 3), **pump), edge("r", 1, 2, "resistance", resistance=4e5 + 100 * i),
        edge("l", 2, 3, "pipe", length=2e3 + i, diameter=0.5), edge("g", 1, 3, "valve", opening=float(i % 5 > 0), xi=2.0 + i, diameter=0.3), edge("o", 3, None, flow=0.01 * (i % 4)),
        edge("b", 3, 4, "resistance", resistance=1e5), edge("e", 4, None, pressure=5e5 + 1e4 * (i % 11)), edge("x", 4, 5, "valve", opening=0.0, xi=1.0, diameter=0.3), edge("y", 5, None, flow=0),
    ]


def test_together_as_alone(monkeypatch):
    nets = [network(i) for i in range(60)]
    starts = [None if i % 2 else {v: 3e5 for v in range(3)} for i in range(60)]
    seen = []
    bound = hydraulics._solve_shape
    monkeypatch.setattr(hydraulics, "_solve_shape", lambda n, s: seen.append(len(n)) or bound(n, s))
    found = hydraulics.solve_networks(copy.deepcopy(nets), starts)
    assert sorted(i for s in found for i in s.which) == list(range(60)) and len(seen) == 2
    for s in found:
        for k, i in enumerate(s.which):
            p, q, fine = hydraulics.solve_network(nets[i], start=starts[i])
            assert bool(s.converged[k]) == fine and set(p) == set(s.vertices) and set(q) == set(s.edges)
            for v, x in zip(s.vertices, s.pressures[k], strict=True):
                assert math.isnan(x) if p[v] is None else x == pytest.approx(p[v], rel=1e-9)
            for e, x in zip(s.edges, s.flows[k], strict=True):
                assert x == pytest.approx(q[e], rel=1e-6, abs=1e-8)
    monkeypatch.setattr(hydraulics, "TOGETHER", 1000)
    few = {i: s.pressures[k] for s in hydraulics.solve_networks(copy.deepcopy(nets), starts) for k, i in enumerate(s.which)}
    for s in found:
        for k, i in enumerate(s.which):
            assert np.allclose(few[i], s.pressures[k], rtol=1e-12, equal_nan=True)


def test_what_no_pressure_reaches():
    alone = [edge(1, None, 0, flow=1.0)]
    with pytest.raises(ValueError, match="needs a given pressure"):
        hydraulics.solve_networks([alone, copy.deepcopy(alone)])
    cut = [edge(1, None, 0, pressure=1e5), edge(2, 0, 1, "valve", opening=0.0, xi=1.0, diameter=0.3), edge(3, 1, None, flow=1.0)]
    with pytest.raises(ValueError, match="flow is given but no pressure"):
        hydraulics.solve_networks([cut])
    assert hydraulics.solve_networks([]) == []


def test_scenarios_stay_whole():
    keys = [None] * 3 + [i // 7 for i in range(70)] + [99] * 50
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 4], pa.int64())], ["k"]) for i in range(0, len(keys), 4)]
    got, sizes = [], []
    for table, firsts in scenarios.whole(iter(batches), ["k"], 20):
        values = table["k"].to_pylist()
        ends = [*firsts[1:], len(values)]
        assert all(len(set(values[a:b])) == 1 for a, b in zip(firsts, ends, strict=True))
        got += [values[a] for a in firsts]
        sizes.append(len(values))
    assert got == [None, *range(10), 99] and sum(sizes) == len(keys) and len(sizes) > 3


def test_a_small_table_is_many_tasks_work(spark):
    rows = spark.range(100).selectExpr("id as k", "inline(array(struct(0L as edge, cast(null as long) as from_v, 0L as to_v, 'source' as kind, map('none', 0d) as params, 1e5 as pressure, cast(null as double) as flow)))")
    found = hydraulics.nodal_pressures(rows, ["k"])
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted((r["k"], r["vertex"], r["pressure"], r["converged"]) for r in found.collect()) == [(i, 0, 1e5, True) for i in range(100)]
