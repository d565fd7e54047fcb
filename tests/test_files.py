from pyspark.sql import functions as F

from tidewright.operators import batches
from tidewright.sources import results, schemes, tags


def test_written_tags_and_profiles_are_read_back(spark, tmp_path):
    rows = [("a b", "2024-01-01 00:00:00", 1.5), ("a b", "2024-01-02 03:04:05", -2.0), ("c", "2024-01-03 00:00:00", None)]
    frame = spark.createDataFrame(rows, "tag string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    tags.write_tags(frame, str(tmp_path / "tags"))
    assert sorted((r["tag"], str(r["ts"]), r["value"]) for r in tags.read_tags(spark, str(tmp_path / "tags")).collect()) == rows
    assert [r["tag"] for r in tags.read_tags(spark, str(tmp_path / "tags"), begin="2024-01-02 03:04:05", end="2024-01-02 03:04:05").collect()] == ["a b"]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "F1.csv").write_text("1.2.2024 3:04:05;7,25\nno time;8\n")
    assert [(r["tag"], str(r["ts"]), r["value"]) for r in tags.read_tags(spark, str(tmp_path / "plain")).collect()] == [("F1", "2024-02-01 03:04:05", 7.25)]
    points = spark.createDataFrame([("p", 200.0, 5.5), ("p", 0.0, 1.0), ("q", 9.0, 2.0)], "pipe string, x double, height double")
    tags.write_profile(points, str(tmp_path / "profiles"))
    assert sorted((r["x"], r["height"]) for r in tags.read_profile(spark, str(tmp_path / "profiles")).collect()) == [(0.0, 1.0), (9.0, 2.0), (200.0, 5.5)]


def test_documents_may_be_rows(spark):
    docs = spark.createDataFrame([('{"A": {"to": 1}, "B": {"from": 1, "to": 2}}',), ('{"C": {"from": 2}}',)], "text string")
    assert {(r["name"], r["edge_type"]) for r in schemes.read_topology(spark, docs, inline=True).collect()} == {("A", "Edge1"), ("B", "Edge2"), ("C", "Edge1")}


def test_sources_of_layers(spark, tmp_path):
    pipes = spark.createDataFrame([(0, "p", 0.5, [0.0], {"density_std": [850.0]})], "step long, name string, flow double, coordinates array<double>, profiles map<string,array<double>>")
    wells = spark.createDataFrame([(0, "w", 0.25), (1, "w", 0.75)], "step long, name string, flow double")
    results.write_layers(results.layers(pipes, wells), str(tmp_path / "layers"))
    assert sorted(map(tuple, results.read_sources(spark, str(tmp_path / "layers")).collect())) == [(0, "w", 0.25), (1, "w", 0.75)]


def test_calendar_rounds_halves_up(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,)], "step long").withColumn("t", batches.calendar("2024-01-01", 0.5, "step"))
    assert [str(r["t"]) for r in rows.orderBy("step").collect()] == ["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:00:02"]
