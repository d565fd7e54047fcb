import json
import math

import numpy as np
import pytest

from tidewright.engine import Engine
from tidewright.functions import profiles
from tidewright.functions.scalar import GRAVITY
from tidewright.operators import hydraulics

CURVE = [310.0, -0.011, -3.4e-6, -1.9e-10]


def pump(**more):
    return {"head_characteristic": CURVE, "initial_frequency": 1.0, "nominal_frequency": 2950.0, "rotor_wheel_reducing": 0.0, "is_initially_started": True, **more}


def station(first, second, gate=1.0, delivery=2.5e6):
    """Intake - pump A - pump B - gate - delivery, and a bypass with a closed gate around both."""
    topology = {"Intake": {"to": 0}, "A": {"from": 0, "to": 1}, "B": {"from": 1, "to": 2}, "Bypass": {"from": 0, "to": 2}, "Gate": {"from": 2, "to": 3}, "Delivery": {"from": 3}}
    objects = {"pumps": {"A": first, "B": second}, "valves": {"Bypass": {"initial_opening": 0.0, "xi": 0.1, "diameter": 0.5}, "Gate": {"initial_opening": gate, "xi": 30.0, "diameter": 0.5}}, "sources": {"Intake": {"pressure": 3e5}, "Delivery": {"pressure": delivery}}}
    return Engine.from_json(json.dumps(topology), json.dumps(objects))


def lift(curve, q, ratio=1.0):
    return 850.0 * GRAVITY * profiles.head_at(curve, q * 3600, ratio)


def test_pumps_in_series_meet_the_delivery_pressure():
    engine = station(pump(), pump())
    assert engine.solve()
    q, p, curve = engine.flows["A"], engine.pressures, profiles.head_curve(CURVE, 0.0, 6000.0)
    assert q > 0.1 and math.isclose(q, engine.flows["B"], rel_tol=1e-9) and math.isclose(q, engine.flows["Gate"], rel_tol=1e-6) and engine.flows["Bypass"] == 0
    assert math.isclose(p[1] - p[0], lift(curve, q), rel_tol=1e-6) and math.isclose(p[2] - p[1], lift(curve, q), rel_tol=1e-6)
    assert math.isclose(p[2] - p[3], 30.0 * 850 / 2 * (q / (math.pi * 0.25 / 4)) ** 2, rel_tol=1e-6)


def test_speed_and_wheel_scale_the_curve():
    engine = station(pump(rotor_wheel_reducing=0.1), pump(initial_frequency=0.9), delivery=2e6)
    assert engine.solve()
    q, p, curve = engine.flows["A"], engine.pressures, profiles.head_curve(CURVE, 0.0, 6000.0)
    for a, b in ((0, 1), (1, 2)):
        assert math.isclose(p[b] - p[a], lift(curve, q, 0.9), rel_tol=1e-6)
    before = q
    engine.control(json.dumps({"controls": {"pumps": {"B": {"frequency": 1.1}}}}))
    assert engine.solve() and engine.flows["A"] > before


def test_a_stopped_pump_is_a_resistance_both_ways():
    engine = station(pump(), pump())
    assert engine.solve(json.dumps({"controls": {"pumps": {"B": {"is_running": False}}, "sources": {"Delivery": {"pressure": 1e6}}}}))
    q, p = engine.flows["B"], engine.pressures
    assert q > 0 and math.isclose(p[1] - p[2], 100.0 * 850 / 2 * (q / (math.pi * 0.01 / 4)) ** 2, rel_tol=1e-6)
    assert hydraulics.pump_law(1e5, 3e5, pump(is_initially_started=False)) == -hydraulics.pump_law(3e5, 1e5, pump(is_initially_started=False))
    with pytest.raises(ValueError, match="pumps"):
        engine.control(json.dumps({"pumps": {"Gate": {"is_running": True}}}))
    with pytest.raises(ValueError, match="head_characteristic"):
        hydraulics.pump_law(1e5, 2e5, {})


def test_power_lifts_the_flow():
    given = pump(efficiency_characteristic=[0.6])
    assert math.isclose(hydraulics.pump_power(0.3, given), 0.3 * lift(profiles.head_curve(CURVE, 0.0, 6000.0), 0.3) / 0.6)


def test_closed_gates_cut_the_network_in_parts():
    engine = station(pump(), pump(), gate=0.0)
    assert engine.solve()
    assert all(abs(q) < 1e-6 for q in engine.flows.values())
    assert engine.pressures[3] == 2.5e6 and math.isclose(engine.pressures[2] - engine.pressures[0], 2 * lift(profiles.head_curve(CURVE, 0.0, 6000.0), 0.0), rel_tol=1e-4)
    edge = lambda i, a, b, **kw: {"edge": i, "from_v": a, "to_v": b, "kind": kw.pop("kind", "resistance"), "params": kw.pop("params", {"resistance": 10.0}), **kw}
    shut = edge(9, 1, 5, kind="valve", params={"opening": 0.0})
    tree = [edge(0, None, 0, pressure=2e5), edge(1, 0, 1), edge(2, 1, None, flow=2.0), shut, edge(3, 5, 6)]
    pressures, flows, fine = hydraulics.solve_network(tree)
    assert fine and pressures[5] is None and flows[3] == 0 and flows[9] == 0 and math.isclose(flows[0], 2.0, rel_tol=1e-6)
    with pytest.raises(ValueError, match="no pressure"):
        hydraulics.solve_network([*tree, edge(4, 6, None, flow=1.0)])
    with pytest.raises(ValueError, match="given pressure"):
        hydraulics.solve_network([edge(1, 0, 1), edge(2, 1, None, flow=1.0)])


def test_large_parts_are_solved_as_small_ones(monkeypatch):
    rng = np.random.default_rng(4)
    n = 60
    edges = [{"edge": i, "from_v": i, "to_v": i + 1, "kind": "resistance", "params": {"resistance": float(rng.uniform(1e4, 1e5))}} for i in range(n)]
    edges += [{"edge": n + k, "from_v": int(a), "to_v": int(b), "kind": "local", "params": {"xi": 5.0, "diameter": 0.4, "opening": 1.0}} for k, (a, b) in enumerate(rng.integers(0, n, (40, 2))) if a != b]
    edges += [{"edge": 900, "from_v": None, "to_v": 0, "kind": "source", "pressure": 5e6}, {"edge": 901, "from_v": n, "to_v": None, "kind": "sink", "flow": 0.8}, {"edge": 902, "from_v": n // 2, "to_v": None, "kind": "sink", "flow": 0.4}]
    p, q, fine = hydraulics.solve_network(edges)
    monkeypatch.setattr(hydraulics, "ELIMINATE", 0)
    p2, q2, fine2 = hydraulics.solve_network(edges)
    assert fine and fine2
    assert np.allclose([p[v] for v in p], [p2[v] for v in p], rtol=1e-7) and all(math.isclose(q[e], q2[e], abs_tol=1e-5) for e in q)
