from tidewright.llm.simhash import drop_near_copies

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
A, B, C = " ".join(WORDS), " ".join(WORDS[::-1]), " ".join(WORDS[1::2] + WORDS[::2])
SCHEMA = "doc_id long, text string, number string"


def left(frame):
    return sorted((tuple(r) for r in drop_near_copies(frame).collect()), key=repr)


def test_rows_without_an_id_are_judged_by_their_texts(spark):
    rows = [(1, A, "a"), (None, A.upper(), "b"), (None, B, "c"), (None, C, "d"), (None, C.upper(), "d"), (None, C, "d"), (None, C, "d")]
    got = left(spark.createDataFrame(rows, SCHEMA))
    assert [(r[0], r[1].lower()) for r in got] == sorted([(1, A), (None, B), (None, C)], key=repr)
    assert got == left(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3))


def test_an_id_with_two_texts_keeps_the_one_of_its_own(spark):
    rows = [(1, A, "a"), (2, A.upper(), "a"), (2, B, "b"), (3, C, "c"), (3, C, "c"), (3, C, "d")]
    got = left(spark.createDataFrame(rows, SCHEMA))
    assert [r[:2] for r in got] == [(1, A), (2, B), (3, C)]


def test_no_rows(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert drop_near_copies(frame).count() == 0
    assert drop_near_copies(frame).columns == ["doc_id", "text", "number"]
