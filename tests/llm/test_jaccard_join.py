import itertools
import random
import re

import numpy as np
import pytest

from tidewright.llm import jaccard_join


def tokens_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(map(tuple, (words[i : i + 3] for i in range(len(words) - 2)))) if len(words) > 2 else {tuple(words)} if words else set()


def brute(rows):
    """(doc_id, set size, smallest id reached) of rows (doc_id, text), by comparing all pairs."""
    sets = [tokens_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    smallest = {k: min((d for d in ds if d is not None), default=None) for k, ds in least.items()}
    return sorted(((d, len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def found(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, key string").repartition(3)
    return sorted((tuple(r) for r in jaccard_join.similar(df).collect()), key=str)


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        at = draw.randrange(len(words))
        words[at : at + draw.choice([0, 1])] = [f"x{draw.randrange(10**6)}"]
    return words


def corpus(seed, bases, sizes, lines):
    draw = random.Random(seed)
    shared = [[f"b{i}w{j}" for j in range(draw.choice([6, 12, 40]))] for i in range(lines)]
    out = []
    for _ in range(bases):
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.choice(sizes))]
        for line in draw.sample(shared, k=min(lines, draw.choice([0, 1, 2, 3]))):
            words += line
        for _ in range(draw.choice([1, 1, 3])):
            out.append(" ".join(edited(draw, words, draw.randrange(max(1, len(words) // 25))) if words else []))
    draw.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "frequent"), [(1, 3), (2, 2), (3, 16)])
def test_equals_all_pairs(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "REPORTED", 2)
    if seed == 1:
        monkeypatch.setattr(jaccard_join, "PAIRS_FROM", 6)
    if seed == 2:
        monkeypatch.setattr(jaccard_join, "FIRST_ROUND", 1)
        monkeypatch.setattr(jaccard_join, "GROWTH", 2)
    rows = corpus(seed, 70, [0, 1, 2, 5, 10, 11, 12, 20, 60, 130, 300], 5)
    want = brute(rows)
    assert found(spark, rows) == want
    assert sum(d != c for d, _, c in want) > 10


def test_texts_made_of_frequent_passages_only(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    monkeypatch.setattr(jaccard_join, "REPORTED", 2)
    draw = random.Random(9)
    lines = [" ".join(f"p{i}w{j}" for j in range(12)) for i in range(14)]
    rows = [(i, " ".join(draw.sample(lines, k=draw.choice([1, 9, 10, 11])))) for i in range(60)]
    rows += [(100 + i, " ".join(lines[:12]) + f" own{i}") for i in range(25)] + [(200, " ".join(lines[:12])), (201, " ".join(lines[:12]))]
    assert found(spark, rows) == brute(rows)


def test_nulls_repeats_and_long_texts(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (2, "One"), (1, "one"), (9, "One two"), (8, "one\ttwo"), (7, "ONE ÉTÉ"), (6, "one été"), (None, "a b c d"), (None, "a b c D"), (12, long), (11, long + " more and more"), (12, long)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_any_two_that_link_share_a_key_of_the_right_kinds():
    draw = random.Random(4)
    for trial in range(400):
        n = draw.choice([9, 10, 15, 18, 19, 20, 31, 33, 64, 70, 127, 140, 300, 1000, 1030, 1150, 2100])
        x = np.array(sorted(draw.sample(range(1 << 62), n)), np.uint64)
        gone, more = draw.randrange(n // 10 + 1), draw.randrange(n // 10 + 2)
        y = np.array(sorted([*draw.sample(x.tolist(), n - gone), *draw.sample(range(1 << 62), more)]), np.uint64)
        both = len(np.intersect1d(x, y))
        often = np.array(draw.sample(x.tolist(), draw.choice([0, n // 3, n - 2, n])), np.uint64)
        if 100 * both < 90 * (len(x) + len(y) - both) or (x.shape == y.shape and (x == y).all()):
            continue
        frequent = jaccard_join.Frequent(often, np.array([draw.randrange(2, 5000) for _ in often], np.int64))
        small, large = sorted((x, y), key=len)
        a, b = ({k: kind for k, kind in zip(*jaccard_join.keys_of(z, frequent), strict=True)} for z in (small, large))
        assert any(a[k] >= jaccard_join.BOTH and b[k] <= jaccard_join.BOTH for k in a.keys() & b.keys()), trial


def near_copies(draw, words, copies, edits):
    return [" ".join(edited(draw, words, edits)) for _ in range(copies)]


def test_pairs_are_told_once_not_for_each_key_they_share(spark, monkeypatch):
    draw = random.Random(6)
    told = []
    whole = jaccard_join._may_link

    def counted(a, rest, *also):
        met = whole(a, rest, *also)
        if "about_a" not in a.columns:
            told.append((met.count(), met.select("a", "id").distinct().count()))
        return met

    monkeypatch.setattr(jaccard_join, "_may_link", counted)
    rows = list(enumerate(near_copies(draw, [f"w{draw.randrange(10**6)}" for _ in range(1500)], 16, 20)))
    assert found(spark, rows) == brute(rows)
    made, pairs = (sum(t) for t in zip(*told, strict=True))
    assert pairs > 30
    assert made <= 3 * pairs


def test_components_are_told_once_and_chains_are_whole(spark, monkeypatch):
    draw = random.Random(8)
    runs = []
    whole = jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda edges: runs.append(1) or whole(edges))
    monkeypatch.setattr(jaccard_join, "FIRST_ROUND", 1)
    monkeypatch.setattr(jaccard_join, "GROWTH", 2)
    words, rows = [f"w{i}" for i in range(200)], []
    for i in range(24):
        rows.append((i * 7 % 24, " ".join(words)))
        at = i * 8 % 200
        words = words[:at] + [f"x{i}a", f"x{i}b", f"x{i}c", f"x{i}d"] + words[at + 4 :]
    rows += [(100 + i, t) for i, t in enumerate(near_copies(draw, [f"v{i}" for i in range(300)], 30, 4))]
    want = brute(rows)
    assert found(spark, rows) == want
    assert {c for d, _, c in want if d < 100} == {0}
    assert len(runs) <= 1
