"""Factors of the parse: each is found where it says, earlier, and reaches as far as a greedy parse must."""

import numpy as np
import pytest

from test_substring_dedup import brute, corpus
from tidewright.llm import substring_dedup as sd
from tidewright.llm.textkit import hashed_rows, hashed_words, words_of


def test_factors_are_earlier_text_and_cover_what_goes(spark):
    docs = corpus()
    words = {i: words_of(t) for i, t in docs}
    order = {i: (i is None, i or 0) for i, _ in docs}
    got = {}
    for r in sd.factors(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect():
        own, ref = words[r["doc_id"]], words[r["ref_id"]]
        a, n, b = r["word"], r["n_words"], r["ref_word"]
        assert own[a : a + n] == ref[b : b + n] and len(own[a : a + n]) == n
        assert (order[r["ref_id"]], b) < (order[r["doc_id"]], a)
        got.setdefault(r["doc_id"], []).append((a, a + n))
    want = brute(docs)
    for i, spans in got.items():
        spans.sort()
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert sum(b - a for a, b in spans) == want[i][1]
    assert {i for i, v in want.items() if v[1]} == set(got)


def test_a_copied_passage_is_one_factor(spark):
    rng = np.random.default_rng(3)
    passage = [f"p{x}" for x in rng.integers(0, 10**6, 700)]
    docs = [(1, "x " * 3 + " ".join(passage)), (2, "a b c " + " ".join(passage[50:600]) + " d e"), (3, " ".join(passage[100:115]))]
    got = [tuple(r) for r in sd.factors(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert got == [(2, 3, 550, 1, 53)]


def test_parse_is_greedy():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n_words, k = 200, int(rng.integers(0, 12))
        a = rng.integers(0, n_words - 20, k)
        n = np.minimum(rng.integers(1, 60, k), n_words - 19 - a)
        ref, ref_a = rng.integers(0, 3, k), rng.integers(0, 3, k) * 40 + a
        reach = {}
        for s, m, r, t in zip(a.tolist(), n.tolist(), ref.tolist(), ref_a.tolist(), strict=True):
            for w in range(s, s + m + 19):
                reach.setdefault((r, t - s), set()).add(w)
        want, at = [], 0
        while at < n_words:
            ends = []
            for (r, shift), held in reach.items():
                e = at
                while e in held:
                    e += 1
                if e > at:
                    ends.append(e)
            if ends:
                want.append((at, max(ends) - at))
                at = max(ends)
            else:
                at += 1
        got = sd.parse(n_words, a, n, ref, ref_a)
        assert [tuple(x) for x in got[:, :2].tolist()] == want
        for s, m, r, t in got.tolist():
            assert {s, s + m - 1} <= reach[r, t - s]


def test_no_document_is_a_copy_of_its_own_listing(spark):
    t = " ".join(f"v{i}" for i in range(50))
    frame = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")
    assert [tuple(r) for r in sd.factors(frame).collect()] == [(None, 0, 50, 1, 0)]
    assert sd.factors(frame.limit(0)).count() == 0


def test_word_hashes_in_pieces_and_of_long_words():
    text = ("ab cd\t\n ef " * 500 + "x" * 5000 + " end").encode()
    assert hashed_words(text, 7).tolist() == hashed_words(text).tolist()
    assert len(hashed_words(text)) == 1502 and len(hashed_words(b" \n ")) == len(hashed_words(b"")) == 0
    left, right = "a", "b"
    for _ in range(11):  # collide under any sum of powers modulo 2**64
        left, right = left + right, right + left
    a, b = hashed_words(f"{left} {right}".encode())
    assert a != b
    rows = [b"a b", b"", b"c", b" "]
    offsets = np.cumsum([0, *map(len, rows)])
    hashes, of = hashed_rows(np.frombuffer(b"".join(rows), np.uint8), offsets)
    assert of.tolist() == [0, 2, 2, 3, 3] and len(hashes) == 3


@pytest.mark.parametrize("length", [400_000])
def test_a_very_long_text(spark, length):
    rng = np.random.default_rng(2)
    words = [f"w{x}" for x in rng.integers(0, 5000, length)]
    docs = [(1, " ".join(words)), (2, " ".join(words[1000:3000] + ["z"] * 5 + words[:50])), (3, " ".join(words[::-1]))]
    got = {r["doc_id"]: r["n_removed"] for r in sd.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 2050, 3: 0}
