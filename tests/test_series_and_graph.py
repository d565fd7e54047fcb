from datetime import datetime, timedelta

import numpy as np
import pytest

from tidewright.operators import graph, identify, mixing, series

T0 = datetime(2025, 1, 1)


def stream(spark, rows):
    return spark.createDataFrame([(tag, T0 + timedelta(seconds=s), v) for tag, s, v in rows], "tag string, ts timestamp, value double")


def test_looks_up_across_slices_of_time(spark):
    rng = np.random.default_rng(3)
    rows = [(tag, int(s), float(v)) for tag in "ab" for s, v in zip(sorted(rng.choice(400_000, 25, replace=False)), rng.random(25), strict=True)]
    asked = [(tag, int(s)) for tag in "abc" for s in rng.choice(400_000, 60, replace=False)] + [(t, s) for t, s, _ in rows[:5]]
    points = spark.createDataFrame([(t, T0 + timedelta(seconds=s), s) for t, s in asked], "tag string, t timestamp, id long")
    for mode in ("linear", "step"):
        got = {(r["tag"], r["id"]): r["value"] for r in series.interpolated(points, stream(spark, rows), mode).collect()}
        assert len(got) == len(set(asked))
        for (tag, s), value in got.items():
            own = sorted((x, v) for t, x, v in rows if t == tag)
            before, after = [p for p in own if p[0] <= s], [p for p in own if p[0] >= s]
            if not before or not after:
                assert value is None
            elif mode == "step" or before[-1][0] == s:
                assert value == before[-1][1]
            else:
                (a, x), (b, y) = before[-1], after[0]
                assert abs(value - (x + (y - x) * (s - a) / (b - a))) < 1e-9


def test_smoothing_carries_over_slices(spark):
    rows = [("a", 20_000 * i, float(i % 7)) for i in range(40)] + [("b", 0, 3.0)]
    got = {(r["tag"], (r["ts"] - T0).total_seconds()): r["smooth"] for r in series.smoothed(stream(spark, rows), 0.3).collect()}
    y = rows[0][2]
    for tag, s, v in rows[:40]:
        y = 0.3 * v + 0.7 * y
        assert abs(got[tag, s] - y) < 1e-9
    assert got["b", 0] == pytest.approx(3.0)


def test_tags_without_common_time_are_an_error(spark):
    with pytest.raises(Exception, match="no time in common"):
        series.period(stream(spark, [("a", 0, 1.0), ("a", 5, 1.0), ("b", 9, 1.0), ("b", 12, 1.0)])).collect()


def test_grid_excludes_its_end(spark):
    bounds = spark.createDataFrame([(T0, T0 + timedelta(hours=2))], "t_start timestamp, t_end timestamp")
    assert [r["step"] for r in series.grid(bounds, 3600).orderBy("step").collect()] == [0, 1]
    assert series.grid(spark.createDataFrame([(T0, T0)], "t_start timestamp, t_end timestamp"), 60).count() == 0


def test_switchings_begin_with_the_first_state(spark):
    rows = [("a", i, v) for i, v in enumerate([0.0, 0.0, 1.0, 2.0, 0.0])]
    assert [((r["ts"] - T0).total_seconds(), r["is_zeroflow"]) for r in series.switchings(stream(spark, rows), 1e-4).orderBy("ts").collect()] == [(0, True), (2, False), (4, True)]


def net(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge long, from_v long, to_v long")


def test_components_with_isolated_vertices_and_loops(spark):
    edges = net(spark, [(0, 1), (1, 2), (5, 5), (7, 6), (None, 9), (2, 0)])
    assert {r["vertex"]: r["component"] for r in graph.components(edges).collect()} == {0: 0, 1: 0, 2: 0, 5: 5, 6: 6, 7: 6, 9: 9}


def test_long_chains_are_one_component(spark):
    edges = net(spark, [(i, i + 1) for i in range(300)])
    assert {r["component"] for r in graph.components(edges).collect()} == {0}


def test_levels_and_cycles(spark):
    edges = net(spark, [(0, 1), (1, 3), (0, 3), (2, 3), (3, 4)])
    assert {r["vertex"]: r["level"] for r in graph.levels(edges).collect()} == {0: 0, 2: 0, 1: 1, 3: 2, 4: 3}
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(net(spark, [(0, 1), (1, 2), (2, 1)]))


def test_hops(spark):
    edges = net(spark, [(0, 1), (2, 1), (2, 3), (8, 9)])
    starts = spark.createDataFrame([(0,)], "vertex long")
    assert {r["vertex"]: (r["rank"], r["before"]) for r in graph.hops(edges, starts).collect()} == {0: (0, None), 1: (1, 0), 2: (2, 1), 3: (3, 2)}


def test_cut_apart_and_boundary(spark):
    edges = net(spark, [(0, 1), (1, 2), (2, 3)])
    halves = {(r["edge"], r["from_v"], r["to_v"], r["half"]) for r in graph.cut_apart(edges, __import__("pyspark.sql.functions", fromlist=["col"]).col("edge") == 1).collect()}
    assert halves == {(0, 0, 1, "whole"), (2, 2, 3, "whole"), (1, 1, None, "sink"), (1, None, 2, "source")}
    inside = spark.createDataFrame([(1,), (2,)], "vertex long")
    assert {(r["edge"], r["inside_v"]) for r in graph.boundary(edges, inside).collect()} == {(0, 1), (2, 2)}
    assert [r["edge"] for r in graph.induced(edges, inside).collect()] == [1]


def test_ascending_an_unknown_place_is_an_error(spark):
    members = spark.createDataFrame([("s", 0, 5)], "subgraph string, local long, vertex long")
    with pytest.raises(Exception, match="no vertex"):
        graph.ascended(spark.createDataFrame([("s", 1)], "subgraph string, local long"), members).collect()


def test_mixing(spark):
    rows = [(1, 1.0, 800.0, 8.0, True), (1, 3.0, 900.0, 27.0, False), (2, 0.0, 850.0, 1.0, True), (3, 0.0, 800.0, 1.0, True), (3, 0.0, 900.0, 1.0, True)]
    got = {r["vertex"]: r for r in mixing.mixed(spark.createDataFrame(rows, "vertex long, flow double, density double, viscosity double, confident boolean"), viscosity="viscosity", confidence="confident").collect()}
    assert got[1]["density"] == 875.0 and got[1]["viscosity"] == pytest.approx((2 / 4 + 9 / 4) ** 3) and not got[1]["confident"]
    assert got[2]["density"] == 850.0 and got[3]["density"] == pytest.approx(850.0)


def test_measurements_overwrite(spark):
    computed = spark.createDataFrame([("a", 1.0, True), ("b", 2.0, False), ("c", 3.0, True)], "place string, value double, confident boolean")
    measured = spark.createDataFrame([("a", 9.0, 1), ("a", 8.0, 2), ("b", 7.0, 1)], "place string, value double, seq int")
    got = {r["place"]: (r["value"], r["confident"], r["replaced"], r["status"]) for r in mixing.overwritten(computed, measured, ["place"]).collect()}
    assert got == {"a": (8.0, True, 1.0, "confident_calculation"), "b": (7.0, True, 2.0, "inconfident_calculation"), "c": (3.0, True, None, "unused")}


def test_gauss_newton():
    x, history, outcome = identify.gauss_newton(lambda xs: [identify.rosenbrock(x) for x in xs], np.array([-1.2, 1.0]))
    assert outcome == "converged" and np.allclose(x, 1, atol=1e-5) and history[0] > history[-1]
    assert identify.golden_section(lambda s: (s - 0.3) ** 2) == pytest.approx(0.3, abs=1e-6)
    assert identify.halving(lambda s: (s - 0.3) ** 2) == 0.5


def test_flow_factor_is_recovered(spark):
    truth = 1.07
    inflow = spark.createDataFrame([(i, 5.0 + i) for i in range(20)], "key long, q double")
    measured = inflow.selectExpr("key", f"q * {truth} as value")
    run = lambda factors: inflow.join(factors).selectExpr("scenario", "key", "q * factor as value")
    x, _, outcome = identify.gauss_newton(identify.factor_residuals(run, measured, [0]), np.array([1.0]))
    assert outcome == "converged" and x[0] == pytest.approx(truth, abs=1e-6)
