import os
import re

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_take_effect(spark):
    from tidewright.llm import simhash
    from tidewright.storage import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mix", "byte_bpe"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = written(stage(spark, docs, SF), f"test-{name}")
        after = docs.collect()
        seen.append(len(after))
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(before[r["doc_id"]] == r["text"] for r in after)
        ids = {r["doc_id"] for r in after}
        if name == "exact_dedup":
            norm = {}
            for i, t in sorted(before.items()):
                norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
            assert ids == set(norm.values())
        if name == "simhash_near_dedup":
            prints = {i: simhash.fingerprint(t) for i, t in before.items()}
            left = {}
            for i in sorted(prints):
                left[i] = i
            changed = True
            while changed:
                changed = False
                for i in prints:
                    for j in prints:
                        if (prints[i] ^ prints[j]).bit_count() <= 3 and left[j] < left[i]:
                            left[i] = left[j]
                            changed = True
            assert ids == {i for i in left if left[i] == i}
        if name == "source_mix":
            assert len(after) >= len(ids)
    assert seen[0] < 200 or seen[1] < seen[0]
    again = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(again) == sorted(tuple(r) for r in docs.collect())


def test_near_copies_and_toxic_documents_go(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
    text = " ".join(words * 3)
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, "quite another text of its own kind and more", "en", None, 1), (4, None, None, None, None), (5, "", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
    assert {r["doc_id"] for r in docs.collect()} <= {1, 3, 4}


def test_every_stage_takes_odd_tables(spark):
    """Clashing names, ties, repeated and null ids, null and empty texts, long texts, and no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, target double, copy string, fp string, key string, number int"
    extra = (1.5, "c", "f", "k", 7)
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "s", 1), (1, words, "en", "s", 1), (2, words, "en", None, 1), (None, words, "de", "s", 2), (None, None, None, None, None), (None, "of its own", None, "t", 3), (4, "", "en", "t", 0), (4, "other text of 4", "en", "t", 0), (5, "long " * 100_000, "en", "s", 9)]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.schema == docs.schema, name
        assert all(tuple(r)[5:] == extra for r in kept.collect()), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    once = corpus_pipeline.STAGES[1][1](spark, docs, SF).collect()
    assert sorted((str(r["text"])[:12], r["doc_id"]) for r in once) == sorted([(words[:12], 1), ("None", None), ("of its own", None), ("other text o", 4), ("long long lo", 5)][:1] + [("", 4), ("of its own", None), ("other text o", 4), ("long long lo", 5)])
