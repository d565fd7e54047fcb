import math

import numpy as np
import pytest

from tidewright.operators import advection, blocks, flows, hydraulics


def test_smallest_golden_network():
    edges = [
        {"edge": "source", "from_v": None, "to_v": 0, "flow": 1.0},
        {"edge": "a", "from_v": 0, "to_v": 1, "kind": "resistance", "params": {"resistance": 500.0}},
        {"edge": "b", "from_v": 1, "to_v": 2, "kind": "resistance", "params": {"resistance": 300.0}},
        {"edge": "sink", "from_v": 2, "to_v": None, "pressure": 1e5},
    ]
    pressures, found, converged = hydraulics.solve_network(edges)
    assert converged
    assert np.allclose([pressures[i] for i in range(3)], [100800, 100300, 100000], atol=0.05)
    assert np.allclose([found[e] for e in ("source", "a", "b", "sink")], 1.0, atol=1e-4)


def test_loops_pipes_pumps_and_closed_valves():
    pipe = {"length": 10_000.0, "diameter": 0.7}
    edges = [
        {"edge": "in", "from_v": None, "to_v": 0, "pressure": 6e6},
        {"edge": "p1", "from_v": 0, "to_v": 1, "kind": "pipe", "params": pipe},
        {"edge": "p2", "from_v": 0, "to_v": 1, "kind": "pipe", "params": pipe | {"diameter": 0.5}},
        {"edge": "pump", "from_v": 1, "to_v": 2, "kind": "pump", "params": {"head": 250.0, "fall": 150.0}},
        {"edge": "shut", "from_v": 1, "to_v": 3, "kind": "valve", "params": {"opening": 0.0, "xi": 1.0, "diameter": 0.3}},
        {"edge": "out", "from_v": 2, "to_v": None, "flow": 0.6},
    ]
    pressures, found, converged = hydraulics.solve_network(edges)
    assert converged and found["shut"] == 0.0
    assert math.isclose(found["p1"] + found["p2"], 0.6, abs_tol=1e-5) and found["p1"] > found["p2"] > 0
    assert math.isclose(pressures[0] - pressures[1], hydraulics.pipe_loss(found["p1"], pipe), rel_tol=1e-6)
    assert pressures[2] > pressures[1]


def test_no_given_pressure_is_an_error():
    with pytest.raises(ValueError, match="pressure"):
        hydraulics.solve_network([{"edge": 1, "from_v": None, "to_v": 0, "flow": 1.0}])


def test_flows_follow_from_meters(spark):
    edges = [("s1", None, 0), ("u1", 0, 1), ("s2", None, 1), ("p", 1, 2), ("d", 2, None)]
    known, useless, lacking = flows.compile_flows(edges, ["s1", "s2", "d"])
    assert useless == ["d"] and lacking == []
    rows = [(t, e, float(v + t)) for t in range(5) for e, v in (("s1", 3), ("s2", 4))]
    got = {(r["t"], r["edge"]): r["flow"] for r in flows.flows_of(spark.createDataFrame(rows, "t long, edge string, value double"), known).collect()}
    assert all(got[t, "p"] == got[t, "d"] == 7 + 2 * t and got[t, "u1"] == 3 + t for t in range(5))
    assert flows.compile_flows(edges, ["s1"])[2] == ["s2", "p", "d"]


def test_reconciliation_closes_all_balances(spark):
    rng = np.random.default_rng(0)
    rows = [(t, e, float(rng.uniform(1, 9))) for t in range(4) for e in range(6)]
    balance = [(0, 0, 1), (0, 1, 1), (0, 2, -1), (1, 2, 1), (1, 3, -1), (1, 4, -1)]
    frame = spark.createDataFrame(rows, "t long, edge long, measured double")
    got = flows.reconciled(frame, spark.createDataFrame(balance, "constraint long, edge long, sign long")).toPandas()
    for _, layer in got.groupby("t"):
        x = layer.set_index("edge")["corrected"]
        assert abs(x[0] + x[1] - x[2]) < 1e-9 and abs(x[2] - x[3] - x[4]) < 1e-9
        assert layer.set_index("edge")["delta"][5] == 0
        weight = 1 / layer.set_index("edge")["measured"].abs()
        gradient = weight * layer.set_index("edge")["delta"]
        assert abs(gradient[0] - gradient[1]) < 1e-9 and abs(gradient[3] - gradient[4]) < 1e-9


def test_limited_steps_make_no_new_extremes_and_keep_the_sum():
    rng = np.random.default_rng(1)
    cells = rng.uniform(800, 900, 40)
    for faces in (advection.upstream_faces, advection.ultimate_faces):
        for velocity in (0.7, -0.7):
            new = advection.fv_step(cells, 850.0, 850.0, velocity, 1.0, 1.0, faces)
            assert new.min() >= min(cells.min(), 850) - 1e-9 and new.max() <= max(cells.max(), 850) + 1e-9
            first, last = (850.0, cells[-1]) if velocity > 0 else (cells[0], 850.0)
            assert math.isclose(new.sum() - cells.sum(), velocity * (first - last), abs_tol=1e-9)
    with pytest.raises(ValueError, match="Courant"):
        advection.fv_step(cells, 850.0, 850.0, 1.5, 1.0, 1.0)
    shifted = advection.fv_step(cells, 1.0, 1.0, 1.0, 1.0, 1.0)
    assert np.allclose(shifted[1:], cells[:-1]) and shifted[0] == 1.0
    assert np.allclose(advection.moc_step(cells, 1.0, 1.0, 1.0, 1.0), shifted)


def test_a_front_arrives_after_the_displacement_time(spark):
    length, diameter, flow, dt = 3000.0, 0.7, 0.5, 60.0
    arrival = length * math.pi * diameter**2 / 4 / flow / dt
    rows = [(1, s, flow, 900.0 if s else 850.0, True) for s in range(int(2 * arrival))]
    got = advection.advected(spark.createDataFrame(rows, "pipe long, step long, flow double, value double, confident boolean"), spark.createDataFrame([(1, length, diameter)], "pipe long, length double, diameter double"), dt, 860.0).orderBy("step").collect()
    crossed = next(r["step"] for r in got if r["outlet"] > 875)
    assert abs(crossed - arrival) < 3
    sure = next(r["step"] for r in got if r["confident"])
    assert crossed <= sure <= arrival * 1.5
    assert got[0]["outlet"] == 850.0


def articulation(edges):
    def parts(skip):
        near = {}
        for _, u, v in edges:
            if skip not in (u, v):
                near.setdefault(u, set()).add(v)
                near.setdefault(v, set()).add(u)
        seen, n = set(), 0
        for s in near:
            if s not in seen:
                n += 1
                todo = [s]
                while todo:
                    x = todo.pop()
                    if x not in seen:
                        seen.add(x)
                        todo += near[x]
        return n, len({x for _, u, v in edges for x in (u, v) if x != skip} - seen)

    whole = parts(None)[0]
    return {x for _, u, v in edges for x in (u, v) if parts(x)[0] + parts(x)[1] > whole}


def test_blocks_meet_at_articulation_vertices():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(3, 12))
        edges = [(i, int(u), int(v)) for i, (u, v) in enumerate(rng.integers(0, n, (int(rng.integers(2, 16)), 2))) if u != v]
        if not edges:
            continue
        found = blocks.biconnected(edges)
        assert sorted(e for b in found for e in b) == sorted(e for e, _, _ in edges)
        of = {}
        for i, b in enumerate(found):
            for e in b:
                _, u, v = next(x for x in edges if x[0] == e)
                of.setdefault(u, set()).add(i)
                of.setdefault(v, set()).add(i)
        assert {v for v, bs in of.items() if len(bs) > 1} == articulation(edges)
