import json
import math

import pytest

from tidewright.engine import Engine
from tidewright.sources import results, schemes, tags

TOPOLOGY = {"WellA": {"to": 0}, "Main": {"from": 0, "to": 1}, "Gate": {"from": 1, "to": 2}, "Depot": {"from": 2}, "WellB": {"to": 1}}
OBJECTS = {
    "pipe": {"Main": {"X_start": 0, "X_end": 3000, "Diameter": 0.7, "Tags": {"vol_flow_std_in": {"Tag": "F1", "Dim": "m3/h"}}}},
    "source": {"WellA": {"std_volflow": 0.5, "density": 870}, "WellB": {"std_volflow": 0.1, "is_initially_zeroflow": True}, "Depot": {"pressure": 1e5}},
    "lumped": {"Gate": {}},
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "topology.json").write_text(json.dumps(TOPOLOGY))
    for kind, named in OBJECTS.items():
        (tmp_path / f"{kind}_data.json").write_text(json.dumps(named))
    (tmp_path / "tags.json").write_text(json.dumps({"Gate": {"density_std_out": "R1", "valve_state_scada": "V1"}}))
    return tmp_path


def test_scheme(spark, folder):
    s = schemes.read_scheme(spark, str(folder), str(folder / "tags.json"))
    edges = {r["name"]: r for r in s.edges.collect()}
    assert {n for n, r in edges.items() if r["edge_type"] == "Edge1"} == {"WellA", "WellB", "Depot"}
    assert sorted(r["edge"] for r in edges.values()) == [0, 0, 1, 1, 2]
    assert {tuple(r) for r in s.tags.collect()} == {("Main", "vol_flow_std", "Inlet", "F1", "m3/h"), ("Gate", "density_std", "Outlet", "R1", "")}
    assert [tuple(r) for r in s.controls.collect()] == [("Gate", "valve_state_scada", "V1")]
    assert s.objects["source"].filter("is_initially_zeroflow").count() == 1
    assert schemes.lumped_states(s.objects).collect()[0]["is_opened"]


@pytest.mark.parametrize(("change", "message"), [({"Extra": {"from": 0, "to": 2}}, "edges without"), (None, "objects without")])
def test_integrity(spark, folder, change, message):
    edges = TOPOLOGY | change if change else {k: v for k, v in TOPOLOGY.items() if k != "WellB"}
    (folder / "topology.json").write_text(json.dumps(edges))
    with pytest.raises(ValueError, match=message):
        schemes.read_scheme(spark, str(folder))


def test_tags(spark, tmp_path):
    (tmp_path / "F1.csv").write_text("01.01.2025 3:00:00;5400,25\n1.1.2025 04:00:00;7200.5\n01.01.2025 5:00:00;x\n")
    (tmp_path / "V1.csv").write_text("01.01.2025 3:00:00;1\n01.01.2025 9:00:00;3\n")
    got = {(r["tag"], r["ts"].hour): r["value"] for r in tags.read_tags(spark, str(tmp_path), end="2025-01-01 05:00:00").collect()}
    assert got == {("F1", 3): 5400.25, ("F1", 4): 7200.5, ("F1", 5): None, ("V1", 3): 1.0}
    bindings = spark.createDataFrame([("F1", "m3/h", 7)], "tag string, dim string, place int")
    bound = tags.read_bound_tags(spark, str(tmp_path / "F1.csv"), bindings).filter("value is not null").orderBy("ts").collect()
    assert [(r["place"], round(r["value"], 9)) for r in bound] == [(7, round(5400.25 / 3600, 9)), (7, round(7200.5 / 3600, 9))]
    assert [r["is_opened"] for r in tags.read_valve_states(spark, str(tmp_path / "V1.csv")).orderBy("ts").collect()] == [True, False]
    with pytest.raises(Exception, match="not a flag"):
        tags.read_tags(spark, str(tmp_path / "V1.csv"), kind="boolean").collect()
    (tmp_path / "V2.csv").write_text("01.01.2025 3:00:00;-1\n")
    with pytest.raises(Exception, match="no valve state"):
        tags.read_valve_states(spark, str(tmp_path / "V2.csv")).collect()
    tags.write_tags(tags.read_tags(spark, str(tmp_path / "F1.csv")).filter("value is not null"), str(tmp_path / "out"))
    assert "01.01.2025 03:00:00;5400.25" in "".join(p.read_text() for p in (tmp_path / "out" / "tag=F1").glob("*.csv"))


def test_synthetic_tags_are_reproducible(spark):
    a, b = (sorted(map(tuple, tags.synthetic(spark, {"q": 5.0, "rho": 850.0}, 50, 60).collect())) for _ in range(2))
    assert a == b and len(a) == 100
    assert all(abs(v / (5.0 if t == "q" else 850.0) - 1) <= 0.02 for t, _, v in a)


def test_bounds(spark):
    text = json.dumps({"layers": [{"step": "1", "transport_measurements": [{"edge": "Main", "type": "vol_flow_std_in", "value": 0.5}, {"vertex": 2, "type": "density_std", "value": 860}], "controls": {"valves": {"V": {"opening": 0.5}}, "sources": {"S": {"pressure": 1e6}}}}, {"step": "2", "controls": {"valves": {"V": {"opening": 0}}}}]})
    measurements, controls = schemes.bounds(spark, text, inline=True)
    assert {(r["step"], r["name"], r["vertex"], r["mtype"], r["side"], r["value"]) for r in measurements.collect()} == {("1", "Main", None, "vol_flow_std", "Inlet", 0.5), ("1", None, 2, "density_std", None, 860.0)}
    assert {(r["step"], r["kind"], r["name"], r["is_opened"], r["pressure"]) for r in controls.collect()} == {("1", "valve", "V", True, None), ("1", "source", "S", None, 1e6), ("2", "valve", "V", False, None)}
    with pytest.raises(Exception, match="pumps"):
        schemes.bounds(spark, json.dumps({"controls": {"pumps": {"P": "x"}, "valves": {"V": {"opening": 1}}}}), inline=True)[1].collect()


def test_results_round_trip(spark, tmp_path):
    rows = [(0, "p", 0.5, [0.0, 200.0], {"density_std": [850.0, 851.5]}), (1, "p", 0.6, [0.0, 200.0], {"density_std": [852.0, 850.0]})]
    frame = spark.createDataFrame(rows, "step long, name string, flow double, coordinates array<double>, profiles map<string,array<double>>")
    results.write_layers(results.layers(frame), str(tmp_path / "r"))
    assert sorted((r["step"], r["name"], r["flow"], r["coordinates"], r["profiles"]) for r in results.read_layers(spark, str(tmp_path / "r")).collect()) == rows
    results.save_history(frame, str(tmp_path / "h"))
    assert results.restore(spark, str(tmp_path / "h"), 1).collect()[0]["flow"] == 0.6


def test_engine_steps_carry_density_along():
    objects = {"pipe": {"Main": {"X_start": 0, "X_end": 3000, "Diameter": 0.7}}, "valve": {"Gate": {"initial_opening": 1.0, "xi": 2.0, "diameter": 0.5}}, "source": OBJECTS["source"]}
    engine = Engine.from_json(json.dumps(TOPOLOGY), json.dumps(objects))
    assert engine.solve()
    assert math.isclose(engine.flows["Gate"], 0.6, abs_tol=1e-6) and engine.pressures[0] > engine.pressures[1] > 1e5
    n = math.ceil(3000 * math.pi * 0.49 / 4 / 0.5 / 60)
    for _ in range(2 * n):
        assert engine.step(60.0)
    assert abs(engine.cells["Main"][-1] - 870) < 1 and engine.trust["Main"][-1] > 0.95
    assert json.loads(engine.results())["layers"][0]["buffers"]["pipes"]["Main"]["profiles"]["density_std_confidence"][-1] == "true"
    again = Engine.from_json(json.dumps(TOPOLOGY), json.dumps(objects))
    again.restore(engine.state())
    assert again.time == engine.time
    with pytest.raises(ValueError, match="pumps"):
        engine.step(bounds=json.dumps({"controls": {"pumps": {"P": {}}}}))
