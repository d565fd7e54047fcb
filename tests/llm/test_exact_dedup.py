from tidewright.llm.exact_dedup import drop_copies, group_copies

SCHEMA = "doc_id long, text string, source string"


def left(frame):
    return sorted((tuple(r) for r in drop_copies(frame).collect()), key=repr)


def test_rows_without_an_id_are_judged_by_their_texts(spark):
    rows = [(1, "", "a"), (None, None, "b"), (None, "of its own", "c"), (None, "another", "d"), (None, "another", "d"), (None, "an  other", "e"), (2, "an other", "f")]
    assert left(spark.createDataFrame(rows, SCHEMA)) == sorted([(1, "", "a"), (None, "of its own", "c"), (None, "another", "d"), (2, "an other", "f")], key=repr)


def test_an_id_with_two_texts_keeps_the_one_of_its_own(spark):
    rows = [(1, "x y", "a"), (2, "x\ty", "a"), (2, "z", "a"), (3, "w", "a"), (3, "w", "a"), (3, "w", "b")]
    got = left(spark.createDataFrame(rows, SCHEMA))
    assert [r[:2] for r in got] == [(1, "x y"), (2, "z"), (3, "w")]
    assert got == left(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3))


def test_columns_of_any_name_and_kind_and_no_rows(spark):
    schema = "doc_id long, text string, h string, `key` map<string,int>, `row` string, `order` array<int>"
    frame = spark.createDataFrame([(2, "a", "h", {"k": 1}, None, [1]), (1, "a", None, None, "r", None)], schema)
    assert [tuple(r) for r in drop_copies(frame).collect()] == [(1, "a", None, None, "r", None)]
    assert drop_copies(frame).schema == frame.schema
    assert drop_copies(frame.limit(0)).count() == 0
    assert group_copies(frame.limit(0)).count() == 0
