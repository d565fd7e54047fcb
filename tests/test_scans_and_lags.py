"""Smoothing over many slices and correlations over many lags, against plain loops."""

import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import series

T0 = datetime(2024, 3, 1)


@pytest.mark.parametrize("alpha", [0.9, 1 / 3, 1e-3, 1e-9])
def test_one_tag_over_ten_thousand_slices(spark, alpha):
    draw = random.Random(5)
    values = [draw.uniform(-1, 1) * 10 ** draw.randint(0, 6) for _ in range(25_000)]
    rows = spark.createDataFrame(pd.DataFrame({"tag": "a", "ts": [T0 + timedelta(hours=10 * i) for i in range(len(values))], "value": values}))
    got = [r["smooth"] for r in series.smoothed(rows, alpha).orderBy("ts").collect()]
    smooth = values[0]
    for value, found in zip(values, got, strict=True):
        smooth = alpha * value + (1 - alpha) * smooth
        assert math.isclose(found, smooth, rel_tol=1e-9, abs_tol=1e-6)


def test_smoothing_without_memory_of_lists(spark):
    rows = spark.createDataFrame([("a", T0, 1.0)], "tag string, ts timestamp, value double")
    plan = series.smoothed(rows, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "BroadcastNestedLoop" not in plan


def test_smoothing_of_nothing_and_of_nulls(spark):
    kind = "tag string, ts timestamp, value double"
    assert series.smoothed(spark.createDataFrame([], kind), 0.3).count() == 0
    rows = spark.createDataFrame([("a", T0, None), (None, T0, 4.0), ("b", T0, 5.0), ("b", None, 7.0)], kind)
    assert {r["value"]: r["smooth"] for r in series.smoothed(rows.filter("ts is not null and tag is not null"), 0.3).collect()} == {5.0: 5.0}


def plain(a, b, most):
    out = {}
    for lag in range(-most, most + 1):
        pairs = [(x, y) for s, x in a for t, y in b if t == s + lag and x is not None and y is not None]
        if pairs:
            n, mx, my = len(pairs), sum(p[0] for p in pairs) / len(pairs), sum(p[1] for p in pairs) / len(pairs)
            vx, vy = sum((p[0] - mx) ** 2 for p in pairs), sum((p[1] - my) ** 2 for p in pairs)
            out[lag] = sum((p[0] - mx) * (p[1] - my) for p in pairs) / math.sqrt(vx * vy) if n > 1 and vx and vy else None
    return out


def test_lags_with_gaps_copies_and_nulls(spark):
    draw = random.Random(11)
    a = [(s, draw.gauss(1e4, 3)) for s in range(4000, 4400) if draw.random() < 0.7] + [(4100, 1e4), (4101, None)]
    b = [(s, draw.gauss(-50, 9)) for s in range(3990, 4390) if draw.random() < 0.8] + [(4100, -44.0), (4100, -44.0)]
    frame = lambda rows: spark.createDataFrame(rows, "step long, value double")
    want = plain(a, b, 60)
    got = {r["lag"]: r["correlation"] for r in series.lag_correlations(frame(a), frame(b), 60).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in want)


def test_lags_of_what_does_not_vary_or_meet(spark):
    frame = lambda rows: spark.createDataFrame(rows, "step long, value double")
    flat = frame([(s, 3.3) for s in range(-20, 20)])
    wave = frame([(s, math.sin(s)) for s in range(-20, 20)])
    assert {r["correlation"] for r in series.lag_correlations(flat, wave, 5).collect()} == {None}
    assert series.lag_correlations(wave, frame([(1000, 1.0), (1001, 2.0)]), 5).count() == 0
    assert series.lag_correlations(wave, frame([]), 5).count() == 0


def test_a_shift_over_blocks_is_found_and_rows_do_not_grow_with_lags(spark):
    wave = spark.range(30_000).select(F.col("id").alias("step"), (F.sin(F.col("id") * F.col("id") / 1e5) + F.sin(F.col("id") / 7)).alias("value"))
    late = wave.select((F.col("step") + 3000).alias("step"), "value")
    found = series.lag_correlations(wave, late, 4000)
    best = found.orderBy(F.desc("correlation")).first()
    assert best["lag"] == 3000 and math.isclose(best["correlation"], 1.0, rel_tol=1e-9)
    assert found.count() == 8001
