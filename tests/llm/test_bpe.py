import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def peer():
    return tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


CODER = bpe.Coder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])))
def test_ids_equal_the_library(peer, text):
    ids = CODER.encode(text)
    assert [int(x) for x in ids.split(",") if x] == peer.encode_ordinary(text)
    assert CODER.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "abcdefg" * 700, " \x1c\x1d x  \n\n y", "<|endoftext|>", "it's 12345 \U0001f600\U0001f600 é" * 3])
def test_odd_texts(peer, text):
    assert [int(x) for x in CODER.encode(text).split(",")] == peer.encode_ordinary(text)


def test_round_trip(spark, peer):
    rows = [(1, "The the,  thé\n", "a"), (2, None, "b"), (3, "", "c"), (1, "The the,  thé\n", "a"), (None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i, len(ids := peer.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, _ in rows}
    assert got == want
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    back = bpe.texts(bpe.tokens(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted(bytes(r["text"]) for r in back) == sorted((t or "").encode() for _, t, _ in rows)


def test_native_fold_equals_python(spark):
    words = [" the", "strengthlessness", "zqxjkvb", "é", " naïveté", "ffffffff", "x"]
    got = bpe.native_word_ids(spark.createDataFrame([(w,) for w in words], "word string"), PATH).collect()
    assert {r["word"]: r["ids"] for r in got} == {w: bpe.fold(w.encode(), bpe.load_ranks(PATH)) for w in words}


def test_long_words_are_not_remembered(peer):
    coder = bpe.Coder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    text = "short " + "x" * 5000 + " short " + "x" * 5000
    assert [int(x) for x in coder.encode(text).split(",")] == peer.encode_ordinary(text)
    assert all(len(w) <= bpe.LONGEST for w in coder.known) and coder.known


def test_clashing_columns_and_a_very_long_text(spark, peer):
    docs = spark.createDataFrame([(1, "ab cd " * 200_000, "x", 5), (1, None, None, None)], "doc_id long, text string, n_tokens string, ids_sha256 int")
    got = {r["n_tokens"] for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {0, len(peer.encode_ordinary("ab cd " * 200_000))}
