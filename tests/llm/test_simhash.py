import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import simhash


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_close_fingerprints_share_a_key(a, bits):
    b = a
    for bit in bits:
        b ^= 1 << bit
    at, keys = simhash.bucket_keys(np.array([a, b], np.uint64))
    assert set(keys[at == 0]) & set(keys[at == 1])


def test_components_equal_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(["a b c d e f g", "A b c d e f g", None, "", " \t", "x", "x y", "q r s t u v w x", "q r s t u v w z", "a b c d e f g"])]
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    for k in range(40):
        base = list(rng.choice(words, 300))
        for _ in range(3):
            copy = list(base)
            copy[int(rng.integers(300))] = "zz"
            docs.append((len(docs), " ".join(copy)))
    docs.append((None, "x"))
    got = simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    prints = [simhash.fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {(d, f"{p:016x}", docs[find(i)][0]) for i, ((d, _), p) in enumerate(zip(docs, prints, strict=True))}
    assert len(got) == len(docs)
    assert {tuple(r) for r in got} == want


def test_fingerprint_rule():
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s, 42) for s in ("a b c", "b c d")]
    assert simhash.fingerprint("A  b\nc d") == hashes[0] & hashes[1]
    assert simhash.fingerprint("É b") == xxhash.xxh64_intdigest("É b".encode(), 42)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp string")
    assert simhash.near_copies(empty).count() == 0
    extra = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "doc_id long, text string, fp string")
    assert sorted(tuple(r) for r in simhash.drop_near_copies(extra).collect()) == [(1, "a", "x")]


def test_large_bucket_spans_without_all_pairs():
    ball = np.array([1 << i for i in range(60)] + [0, 2**63 | 2**62 | 2**61 | 2**60 | 1], np.uint64)
    found = simhash.spanning_links(ball)
    assert len(found) == 60


def test_a_wide_bucket_is_searched_exactly():
    rng = np.random.default_rng(4)
    far = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    near = far[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    chain = [np.uint64(0)]
    for bit in range(60):
        chain.append(chain[-1] ^ np.uint64(1 << bit))
    fps = np.unique(np.concatenate([far, near, np.array(chain, np.uint64)]))

    def parts(links):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {f: find(f) for f in root}

    found = simhash.bucket_links(fps)
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    assert parts(found) == parts(simhash.spanning_links(fps))


def test_a_hot_bucket_and_a_very_long_text(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 2000))
    docs = [(0, " ".join(rng.choice(words, 400_000)))]
    for i in range(1, 700):
        copy = list(base)
        copy[int(rng.integers(2000))] = f"z{i}"
        docs.append((i, " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    prints = {i: simhash.fingerprint(t) for i, t in docs}
    by_print = {}
    for i, p in sorted(prints.items()):
        by_print.setdefault(p, i)
    distinct = np.array(sorted(by_print), np.uint64)
    root = {int(p): int(p) for p in distinct}
    changed = True
    while changed:
        changed = False
        for p in distinct:
            for q in distinct[np.bitwise_count(distinct ^ p) <= 3]:
                a, b = root[int(p)], root[int(q)]
                if by_print[a] != by_print[b]:
                    root[int(p)] = root[int(q)] = a if by_print[a] < by_print[b] else b
                    changed = True
    assert got == {i: by_print[root[p]] for i, p in prints.items()}
    assert len(set(got.values())) < 40
