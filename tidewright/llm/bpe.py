"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a worker remembers of distinct words, at most: so many of them, none longer than LONGEST characters. Only speed depends on it, and memory on nothing else than it and one text.
CACHE, LONGEST = 300_000, 100
#: What \s means to the pattern's own engine, in natural order; Python's \s also has four separators of ASCII.
WHITE = r"\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """The rank map of a tiktoken file: byte strings to their ranks, which are their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def word_pattern(pattern: str) -> regex.Pattern:
    spelled = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
    return regex.compile(spelled)


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: from its single bytes, the neighbours whose union ranks lowest merge, leftmost first, until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 256:
        return _fold_long(parts, ranks)
    get, none = ranks.get, len(ranks)
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (best := min(pairs)) < none:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _fold_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap and linked neighbours, for words of any length."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[u], i, u) for i in range(n - 1) if (u := parts[i] + parts[i + 1]) in ranks]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, union = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or parts[i] + parts[j] != union:
            continue
        parts[i], alive[j], after[i] = union, False, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (u := union + parts[after[i]]) in ranks:
                heapq.heappush(heap, (ranks[u], i, u))
        if before[i] >= 0 and (u := parts[before[i]] + union) in ranks:
            heapq.heappush(heap, (ranks[u], before[i], u))
    return [ranks[p] for p, a in zip(parts, alive, strict=True) if a]


class Coder:
    """Encodes and decodes texts with one rank map; each distinct word is folded once while it is remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.words = word_pattern(pattern).findall
        self.pieces = {str(rank): piece for piece, rank in ranks.items()}
        self.known: dict[str, str] = {}

    def encode(self, text: str | None) -> str:
        """Decimal ids joined by commas; empty for a null or empty text."""
        if not text:
            return ""
        words, known = self.words(text), self.known
        if len(known) > CACHE:
            known.clear()
        own: dict[str, str] = {}
        for w in set(words):
            if w not in known:
                (known if len(w) <= LONGEST else own)[w] = ",".join(map(str, fold(w.encode(), self.ranks)))
        return ",".join([known[w] if w in known else own[w] for w in words] if own else [known[w] for w in words])

    def decode(self, ids: str) -> bytes:
        """The concatenated pieces of decimal ids joined by commas."""
        return b"".join([self.pieces[i] for i in ids.split(",")]) if ids else b""


def _coder(path: str, pattern: str) -> Coder:
    return Coder(load_ranks(path), pattern)


def tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) for each row of docs; a null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [[int(x) for x in s.split(",")] if (s := coder.encode(t.as_py())) else [] for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def texts(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text (binary) for each row of coded(doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {rank: piece for piece, rank in load_ranks(path).items()}
        for batch in batches:
            out = [b"".join([pieces[i] for i in ids.as_py() or []]) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs.

    Texts are encoded whole, and what is decoded is made from the ids alone.
    A null text is empty: no tokens and the hash of nothing. Repeated rows get
    equal results; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in batch.column("text"):
                ids = coder.encode(t.as_py())
                counts.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def native_word_ids(words: DataFrame, path: str) -> DataFrame:
    """word (string) and ids (array of int) by Spark's higher-order functions alone.

    The fold of the module's head written as aggregate() over the byte array of
    each word. The rank map is a literal: an array of buckets, each a map of few
    entries, as element_at() of one large map walks through all its keys.
    """
    ranks = load_ranks(path)
    buckets = 1 << 16
    import xxhash

    rows: list[list[str]] = [[] for _ in range(buckets)]
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        rows[xxhash.xxh64_intdigest(name, 42) & (buckets - 1)].append(f'"{name}":{rank}')
    literal = "[" + ",".join("{" + ",".join(r) + "}" for r in rows) + "]"
    table = F.from_json(F.lit(literal), "array<map<string,int>>")
    mask = F.lit(buckets - 1).cast("long")

    def rank(piece):
        return F.coalesce(F.try_element_at(F.element_at(table, (F.xxhash64(piece).bitwiseAND(mask) + 1).cast("int")), piece), F.lit(1 << 30))

    letters = F.regexp_extract_all(F.hex(F.col("word")), F.lit("(..)"), F.lit(1))

    def merge(parts, _):
        ranked = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, i: F.struct(rank(F.concat(p, F.get(parts, i + 1))).alias("rank"), i.alias("i")))
        best = F.array_min(ranked)
        joined = F.concat(
            F.slice(parts, F.lit(1), best["i"]),
            F.array(F.concat(F.get(parts, best["i"]), F.get(parts, best["i"] + 1))),
            F.slice(parts, best["i"] + 3, F.size(parts)),
        )
        return F.when((F.size(parts) > 1) & (best["rank"] < (1 << 30)), joined).otherwise(parts)

    whole = F.hex(F.col("word"))
    folded = F.aggregate(F.slice(letters, 2, F.size(letters)), letters, merge)
    ids = F.when(rank(whole) < (1 << 30), F.array(rank(whole))).otherwise(F.transform(folded, rank))
    return words.select("word", ids.alias("ids"))
