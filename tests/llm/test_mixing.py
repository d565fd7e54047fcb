from tidewright.llm.exact_dedup import group_copies
from tidewright.llm.mixing import mix, mix_report

SCHEMA = "doc_id long, text string, source string, size string, copies string"


def test_mix_and_report_with_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "a b", "s", "x", "y"), (1, "a b", "s", "x", "y"), (2, None, "s", None, None), (None, "c d e", None, "u", "v"), (None, "f", None, "u", "v"), (3, "", "t", "x", "y")]
    frame = spark.createDataFrame(rows, SCHEMA)
    report = mix_report(frame).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["source_size"]) for r in report) == [(0, 1, 4), (0, 3, 4), (1, 2, 4), (1, 2, 4), (2, 0, 4), (3, 0, 0)]
    mixed = mix(frame)
    assert mixed.columns == frame.columns
    got = mixed.collect()
    assert sum(len((r["text"] or "").split()) for r in got) == sum(r["taken"] for r in report)
    assert mix(frame.limit(0)).count() == mix_report(frame.limit(0)).count() == 0


def test_group_copies_with_nulls_and_repeated_rows(spark):
    rows = [(1, "", "s", None, None), (None, None, "s", None, None), (2, "a", "s", None, None), (2, "a", "s", None, None), (None, "b", "s", None, None)]
    got = group_copies(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1, 2, True), (None, 1, 2, False), (2, 2, 2, True), (2, 2, 2, True), (None, None, 1, True)], key=repr)
