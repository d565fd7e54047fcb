import math

import numpy as np
import pytest

from tidewright.operators import thermal
from tidewright.operators.hydraulics import friction
from tidewright.operators.pipe_tasks import Pipe, frictions

SCHEMA = "pipe string, step long, flow double, p_in double, temperature double, density double, viscosity double, fall double, ambient double"


def history(spark, n, flow=0.2, inlet=lambda s: 320.0, **more):
    rows = [("p", s, flow, 5e6, inlet(s), more.get("density", 850.0), 2e-5, more.get("fall", 0.03), 280.0) for s in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_many_frictions_are_each_one():
    re = np.array([0.0, 0.5, 100.0, 2319.0, 2500.0, 3999.0, 1e4, -1e6])
    assert np.allclose(frictions(re, 2e-4), [friction(x, 2e-4) for x in re])


def test_temperature_falls_along_the_pipe_to_what_it_tends_to(spark):
    pipe, v = Pipe(20_000.0, 0.5), 0.2 / (math.pi * 0.25 / 4)
    dt = thermal.fastest_step(200.0, v)
    pipes = spark.createDataFrame([("p", 20_000.0, 0.5, 4.0)], "pipe string, length double, diameter double, transfer double")
    got = thermal.quasistatic(history(spark, 140), pipes, dt).orderBy("step").collect()
    lam = friction(v * 0.5 / (2e-5 * math.exp(-0.03 * (300 - 293.15))), pipe.roughness / 0.5)
    tends = 280 + lam * 850 * v**3 / (8 * 4.0)
    want = tends + (320 - tends) * math.exp(-4 * 4.0 * 100 * dt / (850 * 2000 * 0.5))
    assert got[0]["t_out"] == 320.0 and got[-1]["t_out"] == pytest.approx(want, abs=0.15)
    assert got[-1]["t_out"] < got[50]["t_out"] < 320
    assert got[-1]["p_out"] < got[0]["p_out"] < 5e6  # colder fluid is thicker


def test_without_exchange_batches_travel_unchanged(spark):
    pipes = spark.createDataFrame([("p", 2000.0, 0.5, 1e-12)], "pipe string, length double, diameter double, transfer double")
    v = 0.2 / (math.pi * 0.25 / 4)
    rows = history(spark, 30, inlet=lambda s: 300.0 if s < 5 else 330.0)
    got = [r["t_out"] for r in thermal.quasistatic(rows, pipes, thermal.fastest_step(200.0, v)).orderBy("step").collect()]
    assert got[13] < 301 and got[16] > 329


def test_soil_warms_and_takes_less(spark):
    pipes = spark.createDataFrame([("p", 5000.0, 0.5)], "pipe string, length double, diameter double")
    zones = {"p": ((0.4, -3.0, 0.0, 2e-6, -1e-6), (0.6, -6.0, 4.0, 2e-6, -1e-6))}
    rows = thermal.quasistatic(history(spark, 400), pipes, 180.0, soil=zones, profiles=True).orderBy("step").collect()
    assert rows[60]["t_out"] < 320 and len(rows[0]["temperatures"]) == 25
    cells = rows[-1]["temperatures"]
    assert all(a >= b - 1e-9 for a, b in zip(cells, cells[1:]))
    assert thermal.Heat(soil=zones["p"]).zones(10)[:, 0].tolist() == [-3.0] * 4 + [-6.0] * 6 and thermal.Heat().zones(3) is None


def test_soil_step_by_hand():
    pipe, heat = Pipe(1000.0, 0.5), thermal.Heat(soil=((1.0, -3.0, 2.0, 1e-5, -2e-5),))
    layers = {"temperature": np.full(5, 310.0), "density": np.full(5, 850.0), "viscosity": np.full(5, 1e-5), "fall": np.zeros(5)}
    t, soil = thermal.exchanged(pipe, heat, 0.0, layers, np.full(5, 285.0), 280.0, 60.0)
    assert soil == pytest.approx(285 + 60 * (1e-5 * 30 - 2e-5 * 5))
    assert t == pytest.approx(310 + 60 * 4 * ((-3 + 2e-5) * 30 - 4e-5 * 5) / (850 * 2000 * 0.5))


@pytest.mark.parametrize(("what", "seen"), [("transfer_factor", "t_out"), ("friction_factor", "p_out")])
def test_factors_are_found_again(spark, what, seen):
    pipes = spark.createDataFrame([("p", 3000.0, 0.5, 3.0)], "pipe string, length double, diameter double, transfer double")
    rows = history(spark, 25, inlet=lambda s: 300.0 + s)
    made = thermal.quasistatic(rows, pipes.selectExpr("*", f"1.4d as {what}"), 200.0)
    factor, sums, outcome = thermal.identified(rows.join(made.select("pipe", "step", seen), ["pipe", "step"]), pipes, 200.0, what, seen)
    assert outcome == "converged" and factor == pytest.approx(1.4, abs=1e-4) and sums[-1] < sums[0]
    with pytest.raises(ValueError):
        thermal.identified(rows, pipes, 200.0, "length")


def test_ramps():
    assert thermal.ramp(6, 1.0, 3.0, 1, 3) == [1.0, 1.0, 2.0, 3.0, 3.0, 3.0]
