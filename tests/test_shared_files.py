"""Files that tags share: their number doesn't grow with that of the tags."""

from datetime import datetime

from tidewright.plans import files
from tidewright.sources import tags

NAMES = ["plain", "a;b", 'quo"ted', "line\nbreak", "per%20cent", "", "tag=x/y", "Größe", None]


def test_any_tag_comes_back(spark, tmp_path):
    rows = [(n, datetime(2024, 2, 1, h), h + 0.5 if h else None) for n in NAMES for h in range(3)]
    given = spark.createDataFrame(rows, "tag string, ts timestamp, value double")
    tags.write_shared(given.withColumn("status", given.value.cast("string")), str(tmp_path / "out"))
    assert sorted(map(tuple, tags.read_shared(spark, str(tmp_path / "out")).collect()), key=str) == sorted(rows, key=str)
    later = tags.read_shared(spark, str(tmp_path / "out"), "2024-02-01 01:00:00", "2024-02-01 01:00:00", "int")
    assert later.count() == len(NAMES) and later.filter("value is not null").count() == 0


def test_many_tags_are_few_files(spark, tmp_path):
    spark.range(3000).selectExpr("id as event_id", "cast(timestamp '2024-01-10 00:00:00' as timestamp_ntz) as ts", "id as user_id", "'view' as event_type", "id / 2 as value", "'{}' as props").write.parquet(f"{tmp_path}/events.parquet")
    found = files.tag_files(spark, str(tmp_path))
    assert len(found.inputFiles()) <= 8
    assert found.selectExpr("count(distinct tag)", "sum(value)").first() == (3000, 2999 * 3000 / 4)
