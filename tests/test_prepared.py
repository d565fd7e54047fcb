"""Batches from tags against a plain loop over the grid."""

import math
from datetime import datetime, timedelta

import pytest

from tidewright.operators import prepared

T0 = datetime(2024, 6, 1)
TAGS = "tag string, ts timestamp, value double"
SWITCHED = "tag string, name string, ts timestamp, value double"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def tags(spark):
    a = [("a", at(10 * i), float(i * i)) for i in range(30)]
    b = [("b", at(7 + 13 * i), 3600.0 * i) for i in range(20)] + [("b", at(50), None)]
    return spark.createDataFrame(a + b + [("unbound", at(10_000), 1.0)], TAGS)


@pytest.fixture(scope="module")
def bindings(spark):
    return spark.createDataFrame([("a", "p1", "density_std", "kg/m3"), ("a", "p2", "density_std", "kg/m3"), ("b", "m1", "vol_flow_std", "m3/h")], "tag string, name string, mtype string, dim string")


def linear(points, t):
    for (s, v), (e, w) in zip(points, points[1:]):
        if s <= t <= e:
            return v + (w - v) * (t - s) / (e - s)


def test_measurements_and_states_on_one_grid(spark, tags, bindings):
    told = [("v", "V", at(-5), 1.0), ("v", "V", at(7), 0.0), ("v", "V", at(26), 1.0), ("v", "V", at(27), 0.0), ("v", "V", at(9000), 1.0), ("v", "V", None, 1.0), ("v", "V", at(40), None)]
    got = prepared.transport(tags, bindings, 20, spark.createDataFrame(told, SWITCHED)).collect()
    begin, end = 7, 254
    n = math.ceil((end - begin) / 20)
    a, b = [(10 * i, i * i) for i in range(30)], [(7 + 13 * i, float(i)) for i in range(20)]
    want = {("density_std", name, s): linear(a, begin + 20 * s) for name in ("p1", "p2") for s in range(n)} | {("vol_flow_std", "m1", s): linear(b, begin + 20 * s) for s in range(n)}
    measured = {(r["mtype"], r["name"], r["step"]): r["value"] for r in got if r["role"] != "state"}
    assert measured.keys() == want.keys() and all(math.isclose(measured[k], want[k], abs_tol=1e-9) for k in want)
    assert {r["role"] for r in got if r["mtype"] == "vol_flow_std"} == {"flow"} and all(r["t"] == at(begin + 20 * r["step"]) for r in got)
    assert sorted((r["step"], r["at"], r["value"]) for r in got if r["role"] == "state") == [(0, at(7), 0.0), (0, at(26), 1.0), (1, at(27), 0.0), (n - 1, at(9000), 1.0)]


def test_bounds_by_switchings(spark, tags, bindings):
    told = spark.createDataFrame([("v", "V", at(60), 1.0), ("v", "V", at(200), 0.0), ("w", "W", at(30), 1.0), ("w", "W", at(150), 1.0)], SWITCHED)
    bound = tags.filter("tag <> 'unbound'")
    assert tuple(prepared.bounds(bound, told, False, True).first()) == (at(60), at(254))
    assert tuple(prepared.bounds(bound, told, True, False).first()) == (at(7), at(150))
    with pytest.raises(ValueError):
        prepared.bounds(bound, None, False)
    late = spark.createDataFrame([("v", "V", at(5000), 1.0)], SWITCHED)
    with pytest.raises(Exception, match="leave no time"):
        prepared.bounds(bound, late, False).collect()


def test_pieces_of_long_grids(spark, tags, bindings, monkeypatch):
    whole = prepared.transport(tags, bindings, 1).orderBy("name", "step").collect()
    monkeypatch.setattr(prepared, "PIECE", 10)
    assert prepared.transport(tags, bindings, 1).orderBy("name", "step").collect() == whole and len(whole) == 3 * 247


def test_wrong_states_and_objects_raise(spark, tags, bindings):
    with pytest.raises(Exception, match="not a state"):
        prepared.transport(tags, bindings, 20, spark.createDataFrame([("v", "V", at(60), 2.0)], SWITCHED)).collect()
    span = prepared.bounds(tags.filter("tag <> 'unbound'"))
    opened = spark.createDataFrame([("P", at(60), 0.4), ("G", at(61), 0.5)], "name string, ts timestamp, value double")
    objects = spark.createDataFrame([("P", "pump"), ("G", "valve")], "name string, kind string")
    fine = prepared.hydraulic(span, 20, opened.filter("name = 'G'"), objects).collect()
    assert [(r["step"], r["role"], r["value"]) for r in fine] == [(2, "opening", 0.5)]
    for names in ("name = 'P'", "name = 'nowhere'"):
        with pytest.raises(Exception, match="no opening"):
            rows = opened if "P" in names else opened.withColumnRenamed("name", "was").selectExpr("'nowhere' as name", "ts", "value")
            prepared.hydraulic(span, 20, rows, objects).collect()


def test_nothing_measured(spark, bindings):
    assert prepared.transport(spark.createDataFrame([], TAGS), bindings, 20, spark.createDataFrame([], SWITCHED)).count() == 0


def test_the_last_tag_is_the_reference(spark, tags):
    got = prepared.with_reference(tags, ["b", "a"], 60).orderBy("step").collect()
    a, b = [(10 * i, i * i) for i in range(30)], [(7 + 13 * i, 3600.0 * i) for i in range(20)]
    assert [r["step"] for r in got] == list(range(5))
    for r in got:
        t = 7 + 60 * r["step"]
        assert math.isclose(r["reference"], linear(a, t)) and math.isclose(r["parameters"][0], linear(b, t), abs_tol=1e-9)
    assert prepared.with_reference(tags, ["b", "nowhere", "a"], 60).count() == 0
    with pytest.raises(ValueError):
        prepared.with_reference(tags, ["a"], 60)
