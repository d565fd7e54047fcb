import math

import numpy as np
import pytest

from tidewright.functions import heat, profiles, scalar, units
from tidewright.operators import transport, zeroflow
from tidewright.operators.transport import Edge

#: Two metered sources meet, a valve follows, then a pipe to the sink.
NET = [
    Edge("WellA", "source", None, 0), Edge("GateA", "lumped", 0, 1), Edge("WellB", "source", None, 3), Edge("GateB", "lumped", 3, 1),
    Edge("Vlv", "lumped", 1, 2), Edge("Main", "pipe", 2, 4, 1000.0, 0.7), Edge("Depot", "source", 4, None),
]


def meters(spark, steps):
    return spark.createDataFrame([(s, n, q) for s in range(steps) for n, q in (("WellA", 0.3), ("WellB", 0.1))], "step long, name string, flow double")


def entering(spark):
    return spark.createDataFrame([("WellA", 800.0), ("WellB", 900.0)], "name string, nominal double")


def test_steady_transport_mixes_and_overwrites(spark):
    measured = spark.createDataFrame([(0, "edge", "GateB", 880.0, 1), (0, "edge", "GateB", 860.0, 2), (1, "vertex", "2", 840.0, 1)], "step long, place_kind string, place string, value double, seq int")
    rows, useless, lacking = transport.metered_transport(NET, meters(spark, 2), entering(spark), measured=measured)
    got = {(r["step"], r["name"]): r for r in rows.collect()}
    assert useless == [] and lacking == [] and len(got) == 14
    assert got[0, "GateB"]["outlet"] == 860.0 and got[0, "GateB"]["confident"] and got[0, "GateB"]["replaced"] == 900.0
    assert got[0, "Vlv"]["outlet"] == pytest.approx((0.3 * 800 + 0.1 * 860) / 0.4) and not got[0, "Vlv"]["confident"]
    assert got[1, "Vlv"]["outlet"] == pytest.approx(825.0)
    assert got[1, "Main"]["outlet"] == 840.0 and got[1, "Depot"]["inlet"] == 840.0 and got[1, "Depot"]["confident"]
    with pytest.raises(ValueError, match="pipe"):
        bad = spark.createDataFrame([(0, "edge", "Main", 1.0, 1)], "step long, place_kind string, place string, value double, seq int")
        transport.metered_transport(NET, meters(spark, 1), entering(spark), measured=bad)


def test_dynamic_transport_delays_by_the_pipe(spark):
    steps = 60
    measured = spark.createDataFrame([(s, "vertex", "2", 850.0 if s == 0 else 870.0, 1) for s in range(steps)], "step long, place_kind string, place string, value double, seq int")
    rows, _, _ = transport.metered_transport(NET, meters(spark, steps), entering(spark), measured=measured, dt=60.0)
    outlet = {r["step"]: r["outlet"] for r in rows.filter("name = 'Depot'").collect()}
    arrival = 1000 * math.pi * 0.49 / 4 / 0.4 / 60
    assert outlet[0] == 850.0 and abs(next(s for s in sorted(outlet) if outlet[s] > 860) - arrival) < 3


def test_cube_root_rule(spark):
    rows, _, _ = transport.metered_transport(NET, meters(spark, 1), spark.createDataFrame([("WellA", 8.0), ("WellB", 27.0)], "name string, nominal double"), rule="cube_root")
    assert {r["name"]: r["outlet"] for r in rows.collect()}["Vlv"] == pytest.approx((0.75 * 2 + 0.25 * 3) ** 3)


def test_lacking_meters_are_an_error(spark):
    with pytest.raises(ValueError, match="without a flow"):
        transport.metered_transport(NET, meters(spark, 1).filter("name = 'WellA'"), entering(spark))


def test_versions_of_the_topology(spark):
    controls = spark.createDataFrame([(0, "v", True), (4, "v", False), (7, "v", True), (7, "w", False)], "step long, name string, is_opened boolean")
    got = [(r["step_from"], r["step_to"], r["closed"]) for r in transport.versions(controls, spark.range(10).withColumnRenamed("id", "step")).orderBy("version").collect()]
    assert got == [(0, 3, []), (4, 6, ["v"]), (7, 9, ["w"])]


def test_zero_flow_parts(spark):
    def split(closed="", resting=""):
        rows = [(i, e.from_v, e.to_v, e.name == closed, e.name == resting) for i, e in enumerate(NET)]
        return zeroflow.split(spark.createDataFrame(rows, "edge long, from_v long, to_v long, is_closed boolean, is_resting boolean"))

    def named(parts, flow):
        return {(NET[r["edge"]].name, r["half"]) for r in parts.filter(f"is_flow = {flow}").collect()}

    assert {n for n, _ in named(split(), True)} == {e.name for e in NET}
    cut = split(closed="GateB")
    assert {n for n, _ in named(cut, True)} == {"WellA", "GateA", "Vlv", "Main", "Depot"}
    assert named(cut, False) == {("WellB", "whole"), ("GateB", "sink"), ("GateB", "source")}
    still = split(resting="WellB")
    assert {n for n, _ in named(still, False)} == {"WellB", "GateB"}
    assert [(r["n"], r["vertex"]) for r in zeroflow.common_vertices(still).collect()] == [(1, 1)]


def test_scalar_laws(spark):
    row = spark.range(1).select(
        scalar.ssqrt(scalar.col(-4.0)).alias("a"), scalar.ssqr(scalar.col(-3.0)).alias("b"), scalar.pseudo_sgn(0.0).alias("c"),
        scalar.drag_reduction("virk", [0.5, 0.1], 20.0).alias("d"), scalar.flag_text(scalar.F.lit(None).cast("boolean")).alias("e"), scalar.fix_small(0.0).alias("f"),
        scalar.viscosity_of(scalar.viscosity_model(scalar.F.lit(30.0), scalar.F.lit(12.0), scalar.F.lit(5.0)), 293.15).alias("g"),
        scalar.viscosity_of(scalar.viscosity_model(scalar.F.lit(5.0), scalar.F.lit(5.0), scalar.F.lit(5.0)), 300.0).alias("h"),
        scalar.range_index(scalar.F.array(*[scalar.F.lit(x) for x in (1.0, 5.0, 9.0)]), 5.0).alias("i"), scalar.is_finite(scalar.F.lit(float("inf"))).alias("j"),
        units.to_si(scalar.F.lit(1.0), scalar.F.lit("kgf/cm2(e)")).alias("k"), units.to_si(scalar.F.lit(7.0), scalar.F.lit("?")).alias("l"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["e"], row["f"], row["h"], row["i"], row["j"], row["l"]) == (-2.0, -9.0, 1.0, "undefined", 1e-8, 5.0, 2, False, 7.0)
    assert row["d"] == pytest.approx(0.5 * 2 / 3) and row["g"] == pytest.approx(12.0) and row["k"] == pytest.approx(98067 + 101325)


def test_heat(spark):
    pipe = dict(start=330.0, ambient=280.0, mass_flow=400.0, density=850.0, capacity=2000.0, diameter=0.7, roughness=2e-4, heat_transfer=2.0)
    profile = spark.range(1).select(heat.shukhov_profile(scalar.F.lit(50), 1000.0, **pipe).alias("p")).first()["p"]
    assert profile[0] == pytest.approx(330.0) and all(a > b > 280 for a, b in zip(profile, profile[1:], strict=False))
    flow = spark.range(1).select(heat.conducted_and_radiated(350.0, 280.0, 0.5, 0.05, 0.04).alias("q")).first()["q"]
    assert flow < 0


def test_profiles(spark):
    points = spark.createDataFrame([("p", 0.0, 10.0, 5.0), ("p", 900.0, 40.0, 3.0), ("p", 1000.0, 20.0, 4.0)], "pipe string, x double, height double, capacity double")
    xs = sorted(r["x"] for r in profiles.subdivided(points, 400.0, ["height", "capacity"]).collect())
    assert xs == [0.0, 300.0, 600.0, 900.0, 1000.0]
    grid = profiles.uniform(points, 200.0).orderBy("x").collect()
    assert [r["x"] for r in grid] == [0.0, 200.0, 400.0, 600.0, 800.0, 1000.0]
    assert (grid[0]["height"], grid[-1]["height"], grid[-2]["height"]) == (10.0, 20.0, 40.0)
    found = profiles.decimated(points.select("pipe", "x"), spark.createDataFrame([("p", 0.0), ("p", 1.0), ("p", 2000.0)], "pipe string, sample double")).orderBy("sample").collect()
    assert [r["x"] for r in found] == [0.0, 900.0, None]


def test_head_curves():
    curve = profiles.head_curve([310.0, -0.011, -3.4e-6, -1.9e-10], 0.0, 5000.0)
    for q in (-100.0, 0.0, 100.0, 2500.0, 4999.0, 9000.0):
        for ratio in (1.0, 0.8):
            assert profiles.flow_at(curve, profiles.head_at(curve, q, ratio), ratio) == pytest.approx(q, abs=1e-5)
    for roots in ([1.0, 2.0, 3.0], [-1.0, 0.5, 7.0]):
        c = np.poly(roots)
        assert profiles.cubic_roots(*c) == pytest.approx(roots)
    assert profiles.cubic_roots(1, 0, 1, -2) == pytest.approx([1.0])


def test_live_forms_equal_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidewright.operators import advection, series
    from tidewright.streaming import live

    rows = [(p, s, 0.5, 850.0 + (s * (p + 3)) % 20, True, 1000.0, 0.7) for p in range(2) for s in range(40)]
    schema = "pipe long, step long, flow double, value double, confident boolean, length double, diameter double"
    for i in range(2):
        spark.createDataFrame([r for r in rows if (r[1] < 20) == (i == 0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    batch = advection.advected(spark.createDataFrame(rows, schema).drop("length", "diameter"), spark.createDataFrame([(0, 1000.0, 0.7), (1, 1000.0, 0.7)], "pipe long, length double, diameter double"), 60.0, 860.0)
    source = tmp_path / "stream"
    source.mkdir()
    for i in range(2):
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            f.rename(source / f"{i}-{f.name}")
        query = live.advected(spark.readStream.schema(schema).parquet(str(source)), 60.0, 860.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(got.columns).collect()))
    tags = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 1.0, 0.0])], "tag string, sec long, value double").select("tag", F.timestamp_seconds("sec").alias("ts"), "value")
    tags.write.parquet(str(tmp_path / "tags"))
    query = live.switchings(spark.readStream.schema(tags.schema).parquet(str(tmp_path / "tags")), 1e-4).writeStream.format("memory").queryName("switched").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("switched").count() == series.switchings(tags, 1e-4).count() == 3
