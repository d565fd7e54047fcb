import json
import math

import pytest

from tidewright.engine import Engine
from tidewright.operators import batches

TOPOLOGY, OBJECTS = batches.describe(
    {"Well": {"to": 0}, "Line": {"from": 0, "to": 1}, "Gate": {"from": 1, "to": 2}, "Port": {"from": 2}},
    {"pipe": {"Line": {"X_start": 0, "X_end": 2000, "Diameter": 0.5}}, "valve": {"Gate": {"initial_opening": 1.0, "xi": 5.0, "diameter": 0.4}}, "source": {"Well": {"std_volflow": 0.2, "density": 870.0}, "Port": {"pressure": 2e5}}},
)


def history(spark):
    rows = [("a", s, json.dumps({"controls": {"sources": {"Well": {"std_vol_flow": 0.1 + 0.01 * s}}}}) if s % 3 == 1 else None) for s in range(20)]
    rows += [("b", s, json.dumps({"valves": {"Gate": {"opening": 0.0}}, "sources": {"Well": {"std_vol_flow": 0.0}}}) if s == 4 else None) for s in range(6)]
    return spark.createDataFrame(rows, "scenario string, step long, controls string").repartition(3)


def by_hand(rows, mode, dt=60.0):
    engine, out = Engine.from_json(TOPOLOGY, OBJECTS), {}
    for i, r in enumerate(sorted(rows, key=lambda r: r["step"])):
        fine = engine.solve(r["controls"] or "{}") if mode == "hydro" or i == 0 else engine.step(dt, r["controls"] or "{}")
        for v, p in engine.pressures.items():
            out[r["step"], str(v)] = (p, None, fine)
        for n, q in engine.flows.items():
            out[r["step"], n] = (None, q, fine)
    return out, engine


@pytest.mark.parametrize("mode", ["hydro", "coupled"])
def test_scenarios_step_as_single_engines_do(spark, mode):
    rows = history(spark)
    got = batches.run(rows, TOPOLOGY, OBJECTS, mode, 60.0).collect()
    for scenario in ("a", "b"):
        want, _ = by_hand([r for r in rows.collect() if r["scenario"] == scenario], mode)
        mine = {(r["step"], r["place"]): (r["pressure"], r["flow"], r["converged"]) for r in got if r["scenario"] == scenario}
        assert set(mine) == set(want)
        for k, (p, q, fine) in want.items():
            assert mine[k][2] == fine
            for x, y in ((mine[k][0], p), (mine[k][1], q)):
                assert (x is None and y is None) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    assert {r["flow"] for r in got if r["scenario"] == "b" and r["step"] == 5 and r["place"] == "Line"} == {0.0}


def test_layers_are_kept_at_regimes_and_solved_again(spark):
    rows = history(spark).filter("scenario = 'a'")
    kept = batches.serialised(rows, TOPOLOGY, OBJECTS, 300.0, dt=60.0)
    layers = {r["step"]: r for r in kept.collect()}
    assert sorted(layers) == [0, 5, 10, 15]
    assert json.loads(layers[10]["layer"])["layers"][0]["buffers"]["pipes"]["Line"]["profiles"]["density_std"]
    again = batches.quasi_stationary(kept.selectExpr("scenario", "step", "state", "cast(null as string) as controls"), TOPOLOGY, OBJECTS).collect()
    for step, r in layers.items():
        engine = Engine.from_json(TOPOLOGY, OBJECTS)
        engine.restore(r["state"])
        for name, cells in engine.cells.items():
            engine.edges[name]["params"]["density"] = float(cells.mean())
        engine.solve()
        assert {(x["place"], x["pressure"]) for x in again if x["step"] == step and x["place_kind"] == "vertex"} == {(str(v), p) for v, p in engine.pressures.items()}


def test_constant_layers_and_modes(spark):
    assert batches.constant(spark.createDataFrame([(1, 2.0)], "place long, value double"), 4).count() == 4
    with pytest.raises(ValueError, match="mode"):
        batches.run(history(spark), TOPOLOGY, OBJECTS, "other")
    assert batches.run(history(spark).limit(0), TOPOLOGY, OBJECTS).count() == 0
