import math
import random

import numpy as np
import pytest

from tidewright.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def brute(rows):
    """Sorted results of rows (id, vector, label), by comparing all pairs with whole numbers of any size."""
    usable = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in v) < 2**61:
            usable.append((i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    rank = lambda s, i: (-s, i is None, i or 0)
    for k, (i, v, label) in enumerate(usable):
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, other) for m, (j, w, other) in enumerate(usable) if m != k]
        for ps, p, _ in sorted([x for x in scored if x[2] == label], key=lambda x: rank(x[0], x[1]))[:5]:
            hard = sorted([x for x in scored if x[2] != label and 30 * ps <= 100 * x[0] <= 90 * ps], key=lambda x: rank(x[0], x[1]))[:10]
            out += [(i, p, n, j, ps, s) for n, (s, j, _) in enumerate(hard, 1)]
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 0.5) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in hard_negatives.mined(df).collect()), key=str)


def rows_of(seed, n, width, spread=1.0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(4, width))
    return [(int(i), [float(x) for x in (centres[i % 4] + spread * draw.normal(size=width)).astype(np.float32)], int(draw.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize(("n", "width", "spread"), [(900, 12, 0.3), (500, 40, 2.0), (301, 1, 1.0)])
def test_equals_all_pairs(spark, monkeypatch, n, width, spread):
    monkeypatch.setattr(hard_negatives, "STEP", 64)
    rows = rows_of(n, n, width, spread)
    assert found(spark, rows) == brute(rows) != []


def test_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    rows = rows_of(1, 800, 6)
    assert found(spark, rows) == brute(rows)


def test_ties_nulls_and_odd_rows(spark):
    draw = random.Random(5)
    rows = [(i, [float(draw.randrange(-2, 3)) for _ in range(4)], draw.randrange(3)) for i in range(0, 700, 5)]
    rows += [(1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [float("nan")] * 4, 1), (4, [float("inf"), 0.0, 0.0, 0.0], 2), (6, [1.0, 1.0, 1.0, 1.0], None)]
    rows += [(8, [1.0, 2.0], 1), (9, [], 2), (11, [3e38, 0.0, 0.0, 0.0], 0), (12, [1e6, -1e6, 0.0, 0.0], 1), (None, [1.0, 1.0, 0.0, 2.0], 2)]
    assert found(spark, rows) == brute(rows) != []


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (5, [1.0, 0.25], 2), (6, [0.5, 0.25], 2), (5, [1.0, 0.25], 2), (9, [1.0, 1.0], 1)]
    assert found(spark, rows) == brute(rows) != []


def test_no_rows_and_no_anchors(spark):
    assert found(spark, []) == found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == found(spark, [(100, [1.0], 1)]) == []


def test_most_pairs_are_discarded_early():
    draw = np.random.default_rng(2)
    x = np.floor(256 * draw.normal(size=(2000, 32)) * np.geomspace(4, 0.05, 32)).astype(np.int64)
    share, axes = np.linalg.eigh(x.T.astype(float) @ x)
    rotation = hard_negatives.Rotation(axes[:, ::-1].copy(), share[::-1])
    assert 0 < rotation.cuts[1] < 8
    block = hard_negatives.Block(rotation, np.arange(20), np.zeros(20, int), np.arange(20), x[:20])
    exact = x @ x[:20].T
    low = np.sort(exact, 0)[-10].astype(float)
    seen = []
    block.verified = lambda x, v, a, most, dense: seen.append(len(v)) or np.einsum("ij,ij->i", x[v], block.x[a])
    v, a, score = block.reach(x, np.ones(exact.shape, bool), low, None)
    assert sorted(zip(v, a, strict=True)) == sorted(zip(*np.nonzero(exact >= low), strict=True))
    assert (score == exact[v, a]).all()
    assert seen[0] < exact.size / 10
