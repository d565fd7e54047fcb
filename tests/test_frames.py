"""What comes after is looked up without frames that run to the end, which are gone through anew for each row."""

import pytest

from tidewright.functions import profiles
from tidewright.operators import series


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


@pytest.fixture(scope="module")
def readings(spark):
    return spark.range(0, 400, 7).selectExpr("id % 3 as tag", "timestamp_seconds(id * 3000) as ts", "cast(id as double) as value")


def test_neighbours_by_time(spark, readings):
    points = spark.range(0, 420, 5).selectExpr("explode(array(0L, 1L, 2L, 9L)) as tag", "timestamp_seconds(id * 3000) as t")
    found = series.around(points, readings, 20_000)
    assert "unboundedfollowing" not in plan(found)
    of = {}
    for r in readings.collect():
        of.setdefault(r["tag"], []).append((r["ts"], r["value"]))
    for r in found.collect():
        own = of.get(r["tag"], [])
        before, after = [x for x in own if x[0] <= r["t"]], [x for x in own if x[0] >= r["t"]]
        assert (r["prev_t"], r["prev_v"]) == (max(before) if before else (None, None))
        assert (r["next_t"], r["next_v"]) == (min(after) if after else (None, None))


def test_points_at_or_after_samples(spark):
    exact = spark.createDataFrame([(p, 10.0 * i) for p in (1, 2) for i in range(20 * p)], "pipe long, x double")
    samples = spark.createDataFrame([(p, s) for p in (1, 2, 3) for s in (-5.0, 0.0, 1e-9, 10.0, 10.1, 190.0, 191.0, 1000.0)], "pipe long, sample double")
    found = profiles.decimated(exact, samples)
    assert "unboundedfollowing" not in plan(found)
    for r in found.collect():
        later = [10.0 * i for i in range(20 * r["pipe"] if r["pipe"] < 3 else 0) if 10.0 * i + 1e-8 >= r["sample"]]
        assert r["x"] == (min(later) if later else None)
