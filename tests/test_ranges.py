"""Range look-ups against two plain loops."""

import random
from datetime import datetime, timedelta

import pytest

from tidewright.operators import ranges

INF, NAN = float("inf"), float("nan")


def pairs(found):
    return sorted((r["p"], r["r"]) for r in found.select("p", "r").collect())


def test_ranges_of_all_widths(spark):
    draw = random.Random(3)
    points = [(i, draw.choice("ab"), draw.choice([1, 1e3, 1e-6, 1e12]) * draw.uniform(-1, 1)) for i in range(300)] + [(900, "a", None), (901, "a", NAN), (902, "b", INF), (903, "b", -INF), (904, None, 0.0)]
    spans = []
    for i in range(200):
        at = draw.choice([1, 1e3, 1e-6, 1e12]) * draw.uniform(-1, 1)
        spans.append((i, draw.choice("ab"), at, at + draw.choice([0, -1, 1e-9, 1, 1e4, 1e12]) * draw.random()))
    spans += [(900, "a", None, 1.0), (901, "a", NAN, 1.0), (902, "b", -INF, INF), (903, "a", 0.0, INF), (904, "b", -INF, 0.0), (905, "a", 1.0, NAN), (906, None, -1.0, 1.0)]
    spans += [(1000 + i, k, x, x + 1.0) for i, (_, k, x) in enumerate(points[:40])]
    want = sorted((p, r) for p, k, x in points for r, g, a, b in spans if k and k == g and None not in (x, a, b) and x == x and a == a and b == b and a <= x < b)
    P, R = spark.createDataFrame(points, "p int, k string, x double"), spark.createDataFrame(spans, "r int, k string, low double, high double")
    found = ranges.containing(P, R, "x", "low", "high", ["k"])
    assert found.columns == ["p", "k", "x", "r", "low", "high"]
    assert pairs(found) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("without", ["points", "ranges", "both"])
def test_nothing_on_a_side(spark, without):
    P = spark.createDataFrame([] if without != "ranges" else [(1, 2.0)], "p int, x double")
    R = spark.createDataFrame([] if without != "points" else [(1, 0.0, 9.0)], "r int, low double, high double")
    assert ranges.containing(P, R, "x", "low", "high").count() == 0


def test_times_and_repeated_rows(spark):
    t0 = datetime(2024, 5, 1)
    P = spark.createDataFrame([(i % 50, t0 + timedelta(minutes=7 * (i % 50))) for i in range(100)], "p int, t timestamp")
    spans = [(i, t0 + timedelta(minutes=i), t0 + timedelta(minutes=i * i)) for i in range(30)]
    R = spark.createDataFrame(spans, "r int, low timestamp, high timestamp")
    want = sorted((i % 50, r) for i in range(100) for r, a, b in spans if a <= t0 + timedelta(minutes=7 * (i % 50)) < b)
    assert pairs(ranges.containing(P, R, "t", "low", "high")) == want


def test_long_integers_beyond_doubles(spark):
    big = 1 << 60
    P = spark.createDataFrame([(i, big + i) for i in range(40)], "p int, x long")
    R = spark.createDataFrame([(i, big + i, big + i + 2) for i in range(0, 40, 3)], "r int, low long, high long")
    assert pairs(ranges.containing(P, R, "x", "low", "high")) == sorted((p, r) for p in range(40) for r in range(0, 40, 3) if r <= p < r + 2)


def test_successive_places(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 740.0), ("a", -3.0), ("b", 5.0), ("b", None), ("b", NAN)]
    got = sorted(tuple(r) for r in ranges.successive(spark.createDataFrame(rows, "k string, x double"), "x", ["k"], 10.0).select("k", "x", "until").collect())
    assert got == [("a", -3.0, 1.0), ("a", 1.0, 740.0), ("a", 1.0, 740.0), ("a", 740.0, INF), ("b", 5.0, INF)]
