"""Files of named tags only are read."""

import pytest

from tidewright.sources import tags


@pytest.fixture
def folder(tmp_path):
    for name, value in (("flow in", "1,5"), ("p_2", "2.5"), ("other", "unread")):
        (tmp_path / f"{name}.csv").write_text(f"01.02.2024 3:04:05;{value}\n02.02.2024 3:04:05;{value}\n")
    return str(tmp_path)


def test_only_named_tags_are_scanned(spark, folder):
    rows = tags.read_tags(spark, folder, only=["p_2", "flow in", "p_2"])
    assert sorted((r["tag"], r["value"]) for r in rows.collect()) == [("flow in", 1.5), ("flow in", 1.5), ("p_2", 2.5), ("p_2", 2.5)]
    assert len(rows.inputFiles()) == 2 and len(tags.read_tags(spark, folder).inputFiles()) == 3
    assert tags.read_tags(spark, folder, "2024-02-02 00:00:00", only=["p_2"]).count() == 1


def test_written_tags_are_read_by_name(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    tags.write_tags(tags.read_tags(spark, folder, only=["p_2", "flow in"]), out)
    rows = tags.read_tags(spark, out, only=["flow in"])
    assert [(r["tag"], r["value"]) for r in rows.collect()] == [("flow in", 1.5)] * 2 and len(rows.inputFiles()) == 1


def test_unknown_tags_raise(spark, folder):
    with pytest.raises(ValueError, match="no file of the tag nowhere"):
        tags.read_tags(spark, folder, only=["p_2", "nowhere"])
    with pytest.raises(ValueError):
        tags.read_tags(spark, folder, only=[])
