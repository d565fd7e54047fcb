"""Indicators, ratios and scale of the quality classifier against plain versions; repeated labels and listings."""

import math
from collections import Counter

import numpy as np

from tidewright.llm import quality_nbsvm as nb
from tidewright.llm.textkit import text_steps


def as_rows(found):
    return nb.Rows([nb.packed(np.array(sorted(f), np.int64)) for f in found])


def mix(x):
    mask = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & mask
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & mask
    return x ^ x >> 31


def brute_indicators(text):
    """Positions by the definitions: bytes by threes, and words' looks by one, two and three."""
    raw, words = text.encode(), text.encode().split()
    mask, turn, wide = nb.BINS - 1, 0x9E3779B97F4A7C15, (1 << 64) - 1
    out = {mix(a << 16 | b << 8 | c) & mask for a, b, c in zip(raw, raw[1:], raw[2:])}
    looks = []
    for i, w in enumerate(words):
        upper = lambda c: 65 <= c <= 90
        other = lambda c: c < 128 and not upper(c) and not 97 <= c <= 122
        kind = 1 if upper(w[0]) else 2 + w[0] % 32 if other(w[0]) else 0
        tail = w[-1] if other(w[-1]) else 0
        caps, marks, size = min(sum(map(upper, w)), 3), min(sum(map(other, w)), 4), min(int(math.log2(len(w) + 1)), 6)
        looks.append(((((kind * 128 + tail) * 4 + caps) * 5 + marks) * 7 + size) * 2 + (i > 0 and words[i - 1] == w))
    out |= {nb.BINS + (mix(s + 1) & mask) for s in looks}
    out |= {2 * nb.BINS + (mix((a * turn + b + 2) & wide) & mask) for a, b in zip(looks, looks[1:])}
    out |= {3 * nb.BINS + (mix((((a * turn + b) & wide) * turn + c + 3) & wide) & mask) for a, b, c in zip(looks, looks[1:], looks[2:])}
    return sorted(out)


def test_indicators_equal_brute_force():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    pool = ["the", "Sea", "BOATS!!", "a", "é", "x1", "###", "ing", "end.", "\n", "  ", "ÀB"]
    texts = ["", "a", "ab", "abc", " \n", *[" ".join(rng.choice(pool, int(n))) for n in rng.integers(1, 40, 60)]]
    found = [f for _, _, raw, offsets in text_steps(pa.array(texts), 200) for f in nb.indicators(raw, offsets)]
    assert [f.tolist() for f in found] == [brute_indicators(t) for t in texts]


def test_packing_is_bounded_and_exact():
    rng = np.random.default_rng(2)
    for n in (0, 1, 4096, 4097, nb.KINDS * nb.BINS):
        found = np.sort(rng.choice(nb.KINDS * nb.BINS, n, replace=False))
        held = nb.packed(found)
        assert nb.unpacked(held).tolist() == found.tolist()
        assert len(held) <= 1 + max(4 * nb.MOST_POSITIONS, nb.KINDS * nb.BINS // 8)


def test_ratios_and_scale_equal_brute_force():
    rng = np.random.default_rng(3)
    found = [set(rng.choice(500, int(rng.integers(1, 40)), replace=False).tolist()) for _ in range(80)]
    good = rng.random(80) > 0.3
    ratio = nb.log_count_ratio(as_rows(found), good)
    counts = [Counter(p for f, g in zip(found, good, strict=True) if g == k for p in f) for k in (False, True)]
    sums = [sum(c.values()) + nb.KINDS * nb.BINS for c in counts]
    for p in [*range(0, 500, 7), 9000]:
        assert math.isclose(ratio[p], math.log((counts[1][p] + 1) / sums[1]) - math.log((counts[0][p] + 1) / sums[0]), rel_tol=1e-9)
    values = nb.Values(as_rows(found), ratio)
    for f, v in zip(found, values, strict=True):
        assert np.allclose(v, ratio[sorted(f)] / math.sqrt(sum(ratio[p] ** 2 for p in f))) and math.isclose(float(v @ v), 1.0)
    margins = np.where(good, 1.0, -1.0) + rng.normal(0, 1, 80)
    slope, shift = nb.scale(margins, good)
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * margins + b)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum() + 0.5e-3 * ((a - 1) ** 2 + b**2)

    assert all(loss(slope, shift) <= loss(slope + da, shift + db) + 1e-9 for da in (-0.02, 0, 0.02) for db in (-0.02, 0, 0.02))


def test_repeated_labels_and_listings_count_once(spark):
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        docs.append((i, " ".join(("Q!!" if bad else "word") + str(x) for x in rng.integers(0, 50, 20))))
        labels.append((i, int(not bad)))
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    once = {r["doc_id"]: r["score"] for r in nb.scores(frame, known).collect()}
    twice = {r["doc_id"]: r["score"] for r in nb.scores(frame.union(frame), known.union(known)).collect()}
    assert once == twice
    more = spark.createDataFrame([(1, 0), (None, 1), (7, None)], known.schema)
    model = nb.learn(frame, known.union(more), sample=50)
    assert model.weight.any()


def test_a_very_long_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000, "x", "y"), (2, "x" * 500_000, None, None), (3, None, "z", "z")], "doc_id long, text string, good string, found string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = nb.scores(docs, labels).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)
