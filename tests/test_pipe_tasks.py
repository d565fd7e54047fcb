import math

import numpy as np
import pytest

from tidewright.operators import pipe_tasks as pt

PIPE = pt.Pipe(20_000.0, 0.7, rise=50.0)
RHO, NU = np.full(100, 860.0), np.full(100, 1e-5)


def test_flow_and_pressure_are_inverse():
    p_out = pt.outlet_pressure(PIPE, 0.6, 6e6, RHO, NU)
    assert pt.flow_between(PIPE, 6e6, p_out, RHO, NU) == pytest.approx(0.6, abs=1e-9)
    profile = pt.pressure_profile(PIPE, 0.6, 6e6, RHO, NU)
    assert profile[0] == 6e6 and profile[-1] == pytest.approx(p_out) and (np.diff(profile) < 0).all()
    assert pt.outlet_pressure(PIPE, 0.6, 6e6, RHO, NU, 0.3) > p_out
    assert pt.outlet_pressure(PIPE, 0.0, 6e6, RHO, NU) == pytest.approx(6e6 - 860 * 9.81 * 50)


def history(spark, factor=1.0):
    rows = [("a", s, 0.5 + 0.02 * (s % 3), 6e6, None, 850.0 + (20 if s > 5 else 0), 1e-5) for s in range(30)]
    return spark.createDataFrame(rows, "pipe string, step long, flow double, p_in double, p_out double, density double, viscosity double")


def test_histories_and_identification(spark):
    pipes = spark.createDataFrame([("a", 20_000.0, 0.7)], "pipe string, length double, diameter double")
    ran = pt.quasistatic(history(spark), pipes, 300.0)
    rows = ran.orderBy("step").collect()
    assert len(rows) == 30 and all(r["p_out"] < r["p_in"] for r in rows)
    back = pt.quasistatic(ran.join(history(spark).select("pipe", "step", "density", "viscosity"), ["pipe", "step"]).withColumn("flow", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("double")), pipes, 300.0).orderBy("step").collect()
    assert [r["flow"] for r in back] == pytest.approx([r["flow"] for r in rows], abs=1e-6)
    truth = pt.quasistatic(history(spark), pipes.selectExpr("*", "1.2 as friction_factor"), 300.0)
    seen = history(spark).drop("p_out").join(truth.select("pipe", "step", "p_out"), ["pipe", "step"])
    factor, sums, outcome = pt.identified(seen, pipes, 300.0, "friction_factor")
    assert outcome == "converged" and factor == pytest.approx(1.2, abs=1e-4) and sums[-1] < 1e-6


def test_temperatures_tend_to_the_stationary_profile():
    values = np.full(100, 300.0)
    for _ in range(2000):
        values = pt.temperature_step(values, 330.0, 0.5, PIPE, 200.0, 100.0, 280.0, 3.0)
    v = 0.5 / PIPE.area
    ends = 330 - 280
    expected = 280 + ends * math.exp(-4 * 3.0 * 20_000 / v / (850 * 2000 * 0.7))
    assert values[-1] == pytest.approx(expected, abs=1.0) and (np.diff(values) <= 1e-9).all()


def test_closing_a_valve_raises_pressure_by_the_wave():
    p, v = np.full(51, 1e6), np.full(51, 1.0)
    none = lambda v: 0.0 * v
    still = pt.transient_step(p, v, 850.0, 1000.0, none, ("p", 1e6), ("v", 1.0))
    assert np.allclose(still[0], p) and np.allclose(still[1], v)
    for _ in range(20):
        p, v = pt.transient_step(p, v, 850.0, 1000.0, none, ("p", 1e6), ("v", 0.0))
    assert p[-1] == pytest.approx(1e6 + 850 * 1000 * 1.0) and v[-1] == 0.0
    assert p[10] == pytest.approx(1e6) and p[40] == pytest.approx(1.85e6)


def test_trimmed_steps():
    x = np.array([1.0, 2.0])
    assert pt.trimmed_step(x, np.array([4.0, -1.0]), relative=np.array([1.0, 1.0])).tolist() == [1.0, -0.25]
    assert pt.trimmed_step(x, np.array([4.0, -5.0]), low=np.array([0.0, 0.0]), high=np.array([3.0, 3.0])).tolist() == [2.0, -2.0]
