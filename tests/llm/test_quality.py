import math
import zlib
from collections import Counter

import numpy as np

from tidewright.llm import quality_nbsvm as nb
from tidewright.llm import quality_rules as qr


def brute_counts(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)]


def test_counts_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [None, "", " \n ", "é ü\né ü\nx", "a b c d e f a b c d e", "\x1c \x85 a\n\na", "a " * 11]
    texts += [" ".join(rng.choice(list("abcdefgh") + ["é#", "x\n"], int(n))) for n in rng.integers(0, 80, 60)]
    for t in texts:
        assert qr.measure(t)[0] == brute_counts(t), t
    ids = rng.integers(0, 7000, 9000)
    ids[4000:4010] = ids[:10]
    ids = np.unique(ids, return_inverse=True)[1]
    windows = Counter(tuple(ids[i : i + 5]) for i in range(len(ids) - 4))
    assert qr.repeat_words(ids) == len({j for i in range(len(ids) - 4) if windows[tuple(ids[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_distance_is_jensen_shannon():
    p, q = np.array([1.0, 3, 0]), np.array([2.0, 0, 2])
    m = [0.375, 0.375, 0.25]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert math.isclose(qr.distance(p, q)[0], math.sqrt((kl([0.25, 0.75, 0]) + kl([0.5, 0, 0.5])) / 2))
    assert qr.distance(p, p * 4) == 0 and qr.distance(p, p * 0) == 1


def test_verdicts(spark):
    good = "The river was full of fish and the men who came from the town were glad that it had not been so cold as in the year before, for they had to be on the boats by day. "
    rng = np.random.default_rng(4)
    prose = [" ".join(rng.permutation(good.split())) for _ in range(30)]
    noise = "zxq### " + " ".join(f"q{i}$$$ r{i}%%%" for i in range(60))
    rows = [(i, p, "en", "z") for i, p in enumerate(prose)] + [(100, noise, "en", None), (101, None, None, None), (102, "", "xx", ""), (103, "one two three", "en", ""), (104, "the same words go on " * 30, "en", ""), (0, prose[0], "en", "z"), (None, prose[1], "fr", "z"), (106, "LOUD!! WORDS!! " + " ".join(f"AB{i}!!" for i in range(80)), "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = qr.verdicts(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["kept"] for i in range(30)) and by[None]["kept"]
    assert not any(by[i]["kept"] for i in (100, 101, 102, 103, 104, 106))
    assert [by[i]["base_failed"] for i in (100, 101, 102, 103, 104, 106)] == [False, True, True, True, True, False]
    for i, t, _, _ in rows:
        assert [by[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == brute_counts(t)
    assert qr.verdicts(docs.limit(0)).count() == 0


def test_dual_coordinate_descent_solves_the_problem():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    signs = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    costs = np.full(60, 0.5)
    w, b = nb.dual_coordinate_descent([np.arange(5)] * 60, list(x), signs, costs, 5, epochs=2000)
    loss = lambda w, b: (w @ w + b * b) / 2 + (costs * np.maximum(0, 1 - signs * (x @ w + b))).sum()
    best = loss(w, b)
    for _ in range(300):
        assert loss(w + 0.05 * rng.normal(size=5), b + 0.05 * rng.normal()) >= best - 2e-3


def test_nbsvm_held_out_accuracy(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(700):
        words = ["".join(rng.choice(list("abcdefghij"), int(n))) for n in rng.integers(2, 8, 60)]
        bad = i % 4 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 8 else [w + "###" for w in words]
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(800, None, None), (801, "", None), (None, "abc def", 2.0), (0, rows[0][1], 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = nb.scores(docs, known).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 700]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert nb.scores(docs.limit(0), known).count() == 0
    assert len({r["score"] for r in nb.scores(docs, known.limit(0)).collect()}) == 1
