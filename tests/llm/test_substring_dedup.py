import hashlib

import numpy as np

from tidewright.llm import substring_dedup as sd
from tidewright.llm.textkit import words_of


def brute(docs):
    first = {}
    texts = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        w = texts[i] = words_of(t)
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    out = {}
    for i, w in texts.items():
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] != (i, s):
                gone |= set(range(s, s + 20))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus():
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(60)]
    draw = lambda n: list(rng.choice(vocabulary, n))
    passages = [draw(int(n)) for n in rng.integers(15, 60, 12)]
    docs = []
    for i in range(150):
        words = draw(int(rng.integers(0, 60)))
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(12))]
            a = int(rng.integers(0, len(p) - 10))
            words += p[a:] if rng.random() < 0.5 else p
            words += draw(int(rng.integers(0, 12)))
        docs.append((int(rng.integers(10**6)) if i % 3 else i, " ".join(words)))
    docs = list(dict(docs).items())
    docs += [(2_000_000, docs[5][1]), (2_000_001, docs[5][1] + " x"), (2_000_002, "a " * 300), (2_000_003, "b c d " * 40), (2_000_004, None), (2_000_005, ""), (2_000_006, " \n\t"), (2_000_007, docs[7][1].replace(" ", " \n\x0b ")), (2_000_008, "é" * 30_000)]
    return docs


def test_equals_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sd.without_repeats(frame, digest=True).collect()}
    assert got == brute(docs)
    assert sum(v[1] for v in got.values()) > 1000


def test_combining_parts_changes_nothing(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(sd, "COMBINE", 50)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sd.without_repeats(frame, digest=True).collect()}
    assert got == brute(docs)


def test_least_in_windows():
    ranks = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 5, 8, 13):
        want = [i + int(np.argmin(ranks[i : i + width])) for i in range(200 - width + 1)]
        assert sd.least_in_windows(ranks, width).tolist() == want


def test_repeated_rows_null_ids_and_empty_tables(spark):
    t = " ".join(f"v{i}" for i in range(50))
    rows = [(1, t, "k"), (1, t, "k"), (None, t, None), (2, "short one", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(((r["doc_id"], r["n_removed"], len(r["kept_text"])) for r in sd.without_repeats(frame).collect()), key=str)
    assert got == sorted([(1, 0, len(t)), (1, 0, len(t)), (None, 50, 0), (2, 0, 9)], key=str)
    assert sd.without_repeats(frame.limit(0)).count() == 0
