"""Stages and reports on repeated rows, null and repeated ids, ties, clashing names, long texts, empty tables and reruns, against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from tidewright.llm import exact_dedup, mixing, simhash

SCHEMA = "doc_id long, text string, source string, size int, target string, copy string, mix_source string, source_size double, copies string, nth string, c0 string, h string, fp string, component string"
FILL = (7, "t", "c", "m", 1.5, "k", "n", "0", "h", "f", "o")


def rows(n=160, seed=4):
    rng = np.random.default_rng(seed)
    pool = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(pool, int(rng.integers(0, 30))))
        doc_id = None if i % 13 == 0 else int(rng.integers(0, 120))
        source = [None, "a", "b", "c", "é", "hot"][min(5, int(rng.integers(0, 9)))]
        out.append((doc_id, text if i % 11 else None, source, *FILL))
    out += [out[5]] * 3 + [(out[8][0], out[9][1], "a", *FILL), (500, " ".join(pool * 700), "hot", *FILL), (501, out[20][1], "b", *FILL), (502, (out[20][1] or "").replace(" ", "\t \n"), "b", *FILL)]
    return out


def brute_mix(table):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in table:
        sizes[r[2]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - 3 * sum(sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free} | {s: 3.0 * sizes[s] for s in capped}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    out = []
    for r in table:
        rate = target[r[2]] / sizes[r[2]] if sizes[r[2]] else 0.0
        draw = int(hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        out.append((r, size(r[1]), sizes[r[2]], target[r[2]], math.floor(rate) + (draw < rate - math.floor(rate))))
    return out


def test_mix_and_report_equal_brute_force(spark):
    table = rows()
    frame = spark.createDataFrame(table, SCHEMA).repartition(3)
    want = brute_mix(table)
    report = mixing.mix_report(frame).collect()
    key = lambda r: str(r[:3])
    got = sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"], r["target"]) for r in report), key=key)
    plan = sorted(((r[0], n, s, n * c, t) for r, n, s, t, c in want), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in plan]
    assert np.allclose([g[4] for g in got], [w[4] for w in plan])
    assert all(r["taken"] <= 3 * r["size"] for r in report)
    mixed = mixing.mix(frame)
    assert mixed.schema == frame.schema
    assert Counter(map(tuple, mixed.collect())) == Counter(r for r, *_, c in want for _ in range(c))
    assert Counter(map(tuple, mixing.mix(frame.repartition(2)).collect())) == Counter(map(tuple, mixed.collect()))


@pytest.mark.parametrize("name", ["target", "copy", "size", "mix_source", "copies", "source_size", "c0"])
def test_mix_keeps_a_clashing_column(spark, name):
    frame = spark.createDataFrame([(1, "a b", "s", "own"), (2, "c", "s", None)], f"doc_id long, text string, source string, {name} string")
    assert {r[name] for r in mixing.mix(frame).collect()} <= {"own", None}
    assert mixing.mix(frame).schema == frame.schema


def test_mix_of_sources_without_words(spark):
    frame = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")
    assert mixing.mix(frame).count() == 0
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in mixing.mix_report(frame).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_copies_equal_brute_force(spark):
    table = rows(seed=9)
    frame = spark.createDataFrame(table, SCHEMA).repartition(4)
    groups = {}
    for r in table:
        groups.setdefault(normal(r[1]), []).append(r)
    least = {t: min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for t, g in groups.items()}
    got = Counter(map(tuple, exact_dedup.group_copies(frame).collect()))
    assert got == Counter((r[0], least[t], len(g), r[0] == least[t], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for r in g)
    left = exact_dedup.drop_copies(frame)
    assert left.schema == frame.schema
    assert sorted(((normal(r["text"]), r["doc_id"]) for r in left.collect()), key=str) == sorted(least.items(), key=str)


def test_near_copies_drop_equals_brute_force(spark):
    table = rows(seed=12)
    frame = spark.createDataFrame(table, SCHEMA).repartition(4)
    prints = [simhash.fingerprint(r[1]) for r in table]
    root = list(range(len(table)))
    changed = True
    while changed:
        changed = False
        for i in range(len(table)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    least = {}
    for i, r in enumerate(table):
        least[root[i]] = min(least.get(root[i], (True, 0)), (r[0] is None, r[0] or 0))
    left = simhash.drop_near_copies(frame)
    assert left.schema == frame.schema
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect())) == sorted(least.values())
    assert Counter(map(tuple, left.collect())) - Counter(table) == Counter()
