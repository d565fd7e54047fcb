import numpy as np
import pytest

from tidewright.llm import toxicity
from tidewright.llm.toxicity import Automaton, Lexicon, Scanner


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = np.random.default_rng(5)
    draw = lambda n: "".join(rng.choice(list("abcdé"), n))
    terms = sorted({draw(int(rng.integers(4, 7))) for _ in range(25)})
    lexicon = Lexicon([(t, i % 7 == 0, 0.99, i % 7 != 0 and i % 2 == 0) for i, t in enumerate(terms)])
    words = [draw(int(rng.integers(0, 9))) for _ in range(4000)] + terms
    for word, (term, edits) in zip(words, Automaton(lexicon).match(words).tolist(), strict=True):
        stem = any(s and word.startswith(t) for t, s, *_ in lexicon.terms)
        whole = min((distance(word, t) for t, s, _, f in lexicon.terms if not s and (f or word == t)), default=9)
        want = 0 if stem else whole
        assert (term >= 0, edits if term >= 0 else 0) == (want <= 1, want if want <= 1 else 0), word


@pytest.mark.parametrize(("text", "toxic"), [("You are a stupid fool", True), ("what a STUPPID thing!", True), ('they wrote "stupid" on it', False), ("the word stupid has six letters", False), ("a fine day", False), ("", False), (None, False), ("x" * 50_000 + " stupid", True)])
def test_context_separates_quotation_from_abuse(text, toxic):
    scanner = Scanner(Lexicon([("stupid", False, 0.99, True)]))
    assert (scanner.score(text) >= toxicity.THRESHOLD) == toxic


def corpus(spark, n=600):
    rng = np.random.default_rng(1)
    words = [f"q{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    docs, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, 60))
        if toxic := i % 5 == 0:
            text[int(rng.integers(60))] = str(rng.choice(["scumble", "wretcho"]))
        docs.append((i, " ".join(text), "src"))
        labels.append((i, 1, int(toxic)))
    docs += [(None, None, None), (n, "", "s"), (0, docs[0][1], "src")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(spark)
    rows = toxicity.scores(docs, labels).collect()
    assert len(rows) == docs.count()
    import zlib

    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 5 == 0)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r["predicted"] for r in rows)


def test_empty_tables(spark):
    docs, labels = corpus(spark, 20)
    assert toxicity.scores(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.scores(docs, labels.limit(0)).collect()} == {0.0}
