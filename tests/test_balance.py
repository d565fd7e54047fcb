import pytest

from tidewright.operators import balance, compare
from tidewright.settings import parse

#: Two inlets, a pair of parallel pipes, a triangle and an outlet.
EDGES = [("in1", None, 0), ("in2", None, 1), ("a", 0, 1), ("p1", 1, 2), ("p2", 1, 2), ("b", 2, 3), ("t1", 3, 4), ("t2", 4, 5), ("t3", 3, 5), ("out", 5, None), ("side", 4, None)]


def test_flows_through_loops():
    known, useless, lacking = balance.compile_block_flows(EDGES, ["in1", "in2", "side", "out"], halve_pairs=True)
    assert useless == ["out"]
    assert known["b"] == {"in1": 1.0, "in2": 1.0} and known["a"] == {"in1": 1.0}
    assert known["p1"] == known["p2"] == {"in1": 0.5, "in2": 0.5}
    assert known["out"] == {"in1": 1.0, "in2": 1.0, "side": -1.0}
    assert lacking == ["t1", "t2", "t3"]
    assert balance.compile_block_flows(EDGES, ["in1", "in2", "side", "t1"])[0]["t3"] == {"in1": 1.0, "in2": 1.0, "t1": -1.0}


def test_constraints_of_redundant_meters(spark):
    rows, lacking = balance.constraints(EDGES, {"in1", "in2", "b", "side", "out"})
    by = {}
    for part, e, sign in rows:
        by.setdefault(part, set()).add((e, sign))
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, [{("in1", 1), ("in2", 1), ("b", -1)}, {("b", 1), ("side", -1), ("out", -1)}])) and lacking == []
    assert balance.constraints(EDGES, {"in1", "out"})[1] == [0]
    assert balance.constraints(EDGES, {"in1", "in2", "out"}) == ([], [])
    meters = spark.createDataFrame([(t, e, v) for t in range(3) for e, v in (("in1", 3.0), ("in2", 2.0 + t), ("b", 5.5), ("side", 1.0), ("out", 4.2))], "t long, edge string, measured double")
    for t in range(3):
        x = {r["edge"]: r["corrected"] for r in balance.analysed(meters, EDGES).collect() if r["t"] == t}
        assert x["in1"] + x["in2"] == pytest.approx(x["b"]) == pytest.approx(x["side"] + x["out"])


def test_levels_of_blocks():
    level = balance.block_levels(EDGES, [0])
    assert level[0] == 0 < level[1] < level[2] < level[3] < level[5]
    with pytest.raises(ValueError, match="not reached"):
        balance.block_levels([*EDGES, ("far", 8, 9)], [0])


def test_comparison_of_series(spark):
    computed = spark.createDataFrame([("a", s, float(s % 5), "confident_calculation" if s > 3 else "unused") for s in range(30)] + [("b", 0, 1.0, "unused")], "place string, step long, value double, status string")
    measured = spark.createDataFrame([("a", s, float(s % 5) + 1) for s in range(30)], "place string, step long, value double")
    pairs = compare.confident_pairs(computed, measured, ["place", "step"])
    assert pairs.count() == 26
    assert [(r["bin"], r["n"]) for r in compare.error_histogram(pairs).collect()] == [(0, 26)]
    assert compare.confident_steps(computed).first()["steps"] == list(range(4, 30))
    assert compare.with_any_confidence(computed).select("place").distinct().count() == 1
    wave = [float((7 * s * s) % 31) for s in range(60)]
    a = spark.createDataFrame([(s, wave[s]) for s in range(50)], "step long, value double")
    b = spark.createDataFrame([(s + 4, wave[s]) for s in range(50)], "step long, value double")
    moved, lag = compare.shifted_by_best_lag(a, b, 8, 3)
    assert lag == 4 and moved.join(a, ["step", "value"]).count() == 50


def test_settings():
    s = parse('{"cell_metres": 100, "newton": {"rounds": 5}}')
    assert (s.cell_metres, s.newton.rounds, s.newton.tolerance, s.flows.halve_pairs) == (100, 5, 1e-6, False)
    with pytest.raises(ValueError, match="no setting"):
        parse('{"newton": {"x": 1}}')
    with pytest.raises(ValueError, match="unknown method"):
        parse('{"method": "x"}')
