"""N-gram Jaccard join: prefixes whose frequent tokens are indexed in pairs and whose rare ones singly, then verified.

A document is the set of its distinct shingles, its tokens. All sets are put in
one order, rare tokens first. If y is similar enough to x, it lacks few tokens
of x, so of a long enough prefix of x it has some. A rare token that both have
is a key of its own. Frequent tokens are told apart into classes by their hash,
and two tokens of one class that both have are a key: one shared token of a
class isn't enough, which is why such prefixes are extended until, with one
token of each class left out, they still have one more than y may lack. In very large
sets every token counts as frequent.

Of the two documents of a link the smaller one needs the shorter prefix (it
lacks less of the larger one); keys are told apart by the binary order of
magnitude of the larger one's size, as the number of classes goes by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tidewright.llm.textkit import WORD, hashed_rows, mix64, text_steps
from tidewright.operators.components import components
from tidewright.storage import discarded, written

SHINGLE = 3
#: Two documents link when ALIKE * intersection >= PERCENT * union.
ALIKE, PERCENT = 100, 90

#: Tokens that a task counts at a time, and documents among them that make a token worth reporting.
CHUNK, REPORTED = 1 << 22, 4
#: A token in so many documents is frequent; in more, where there would be over MOST_FREQUENT frequent ones.
FREQUENT, MOST_FREQUENT = 16, 1 << 20
#: Tokens of a document's order of magnitude for each class of frequent tokens.
CLASS_SHARE = 20
#: From this order of magnitude on (sets of 1024 and more) all tokens are indexed in pairs: long texts share single tokens with many others.
PAIRS_FROM = 11
#: Sets that a task remembers so as not to tell their keys again.
REMEMBERED = 1 << 20
#: Sets whose keys a task gives at a time.
KEYED = 2048
#: Least words of 64 bits of a set's parity sketch; a set of more tokens than bits has the next power of two that holds them.
SKETCH = 8
#: Bits of the table of documents whose sets a round verifies.
SLOTS = 1 << 26
#: Sets of a bucket are of about one size within this factor; the shifts of such sizes that are gone through before the rounds; orders of magnitude up to which all keys are looked at there.
ALIKE_SIZES, NEAREST, FEW_KEYS = 1.05, (0.0,), 8
#: Documents of a bucket that the rest of it is compared with in the first round, and how much more in each later one.
FIRST_ROUND, GROWTH = 2, 16
#: Least keys of a set that go with each of its rows, so that two sets that have one of them in common meet there only.
LEADING = 6

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_APART = np.uint64(0x27D4EB2F165667C5)
_ASCII_UPPER = np.array([0x20 if 0x41 <= c <= 0x5A else 0 for c in range(256)], np.uint8)

PROBE, BOTH, INDEX = 0, 1, 2
#: The words of a sketch halved down to the least size, which go with a document's keys.
FOLDED = [f"f{i}" for i in range(SKETCH)]


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its tokens in order): hashes of the distinct shingles of lower-cased words, of all words if there are fewer."""
    for start, _, raw, offsets in text_steps(column):
        words, of = hashed_rows(raw + _ASCII_UPPER[raw], offsets)
        run = words * _ODD[0]
        run[: len(words) - 1] += words[1:] * _ODD[1]
        run[: max(0, len(words) - 2)] += words[2:] * _ODD[2]
        run = mix64(run)
        for i in range(len(of) - 1):
            a, n = of[i], of[i + 1] - of[i]
            if n >= SHINGLE:
                tokens = np.sort(run[a : a + n - SHINGLE + 1])
                yield start + i, tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])]
            elif n:
                few = np.add.reduce(words[a : a + n] * np.array(_ODD[:n])) + np.uint64(n) * _APART
                yield start + i, mix64(np.array([few], np.uint64))
            else:
                yield start + i, np.zeros(0, np.uint64)


def set_hashes(tokens: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return np.add.reduce(mix64(tokens)), np.add.reduce(mix64(tokens ^ _APART))


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each of some hash values, whether an odd number of tokens has it: two sets differ by at least as many tokens as bits.

    They are a power of two, at least as many as tokens, so sets that have
    little in common differ in far more bits than linked ones may. The two halves of a
    sketch, one exclusive or the other, are the sketch of half the size.
    """
    bits = max(64 * SKETCH, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


class Remembered:
    """Whether a set was seen before, as far back as is remembered; forgetting costs repeated rows only."""

    def __init__(self) -> None:
        self.sets: set[tuple] = set()

    def __call__(self, key: tuple) -> bool:
        if key in self.sets:
            return True
        if len(self.sets) >= REMEMBERED:
            self.sets.clear()
        self.sets.add(key)
        return False


_FACTS = [StructField("h1", LongType()), StructField("h2", LongType()), StructField("sketch", ArrayType(LongType())), StructField("folded", ArrayType(LongType()))]


def described(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: (doc_id, n, h1, h2, sketch, folded) for each document, and (token, many) for tokens of many documents of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count, seen = [], 0, Remembered()

        def reported() -> pa.RecordBatch:
            tokens, many = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = many >= REPORTED
            size = int(keep.sum())
            empty = [pa.nulls(size, f.type) for f in arrow][: len(arrow) - 2]
            return pa.RecordBatch.from_arrays([*empty, pa.array(tokens[keep].view(np.int64)), pa.array(many[keep])], schema=arrow)

        for batch in batches:
            sizes, facts = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2), np.int64)
            sketches, folded = [np.zeros(0, np.int64)] * batch.num_rows, np.zeros((batch.num_rows, SKETCH), np.int64)
            for row, tokens in shingle_sets(batch.column("text")):
                sizes[row] = len(tokens)
                if not len(tokens):
                    continue
                h = np.array(set_hashes(tokens), np.uint64)
                facts[row], sketches[row] = h.view(np.int64), parities(tokens)
                folded[row] = np.bitwise_xor.reduce(sketches[row].reshape(-1, SKETCH), 0)
                if not seen(tuple(h.tolist())):
                    waiting.append(tokens)
                    count += len(tokens)
                    if count >= CHUNK:
                        yield reported()
                        waiting, count = [], 0
            none = [pa.nulls(batch.num_rows, pa.int64())] * 2
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sketches])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *sketches])))
            least = pa.ListArray.from_arrays(pa.array(np.arange(0, folded.size + 1, SKETCH, dtype=np.int32)), pa.array(folded.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), *[pa.array(np.ascontiguousarray(f)) for f in facts.T], lists, least, *none], schema=arrow)
        if waiting:
            yield reported()

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n", LongType()), *_FACTS, StructField("token", LongType()), StructField("many", LongType())])
    arrow = to_arrow_schema(schema)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Frequent:
    """The frequent tokens and the order they come in: by how many documents have them, then by hash."""

    def __init__(self, tokens: np.ndarray, many: np.ndarray) -> None:
        order = np.argsort(tokens)
        self.tokens = tokens[order]
        self.level = np.log2(np.maximum(many[order], 1)).astype(np.int8)
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(tokens & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def split(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rare, frequent) tokens of a set, each in order."""
        maybe = np.flatnonzero(self.hint[(tokens & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(maybe):
            return tokens, tokens[:0]
        at = np.minimum(np.searchsorted(self.tokens, tokens[maybe]), len(self.tokens) - 1)
        sure = self.tokens[at] == tokens[maybe]
        maybe, at = maybe[sure], at[sure]
        rare = np.ones(len(tokens), bool)
        rare[maybe] = False
        return tokens[rare], tokens[maybe[np.argsort(self.level[at], kind="stable")]]


def lacking(n: int) -> tuple[int, int]:
    """How many tokens of a document of n a linked one may lack at most: one that is no larger, and one that is no smaller."""
    whole = ALIKE + PERCENT
    return n - -(-PERCENT * n // ALIKE), n - -(-2 * PERCENT * n // whole)


def classes_of(band: int) -> int:
    return max(1, (1 << band) // CLASS_SHARE)


def prefix_keys(rare: np.ndarray, frequent: np.ndarray, band: int, lacks: int, lacks_index: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, whether each is one of the shorter prefix too) of a prefix that shares a key with whatever lacks at most so many of its tokens."""
    if band >= PAIRS_FROM:
        rare, frequent = rare[:0], np.concatenate([rare, frequent])
    salt = mix64(np.array([band], np.uint64) * _ODD[1])[0]
    single = rare[: lacks + 1]
    keys, inner = [mix64(single ^ salt)], [np.arange(len(single)) <= lacks_index]
    if (need := lacks + 1 - len(single)) > 0:
        kind = (mix64(frequent ^ _APART) % np.uint64(classes_of(band))).astype(np.int64)
        again = np.ones(len(frequent), np.int64)
        again[np.unique(kind, return_index=True)[1]] = 0
        spare = np.cumsum(again)
        stop = int(np.searchsorted(spare, need)) + 1
        need_index = lacks_index + 1 - len(single)
        stop_index = int(np.searchsorted(spare, need_index)) + 1 if need_index > 0 else 0
        order = np.argsort(kind[:stop], kind="stable")
        placed, tokens = kind[:stop][order], frequent[:stop][order]
        for d in range(1, stop):
            same = np.flatnonzero(placed[d:] == placed[:-d])
            if not len(same):
                break
            a, b = tokens[same], tokens[same + d]
            keys.append(mix64((np.minimum(a, b) * _ODD[0] + np.maximum(a, b) * _ODD[2]) ^ salt))
            inner.append((order[same] < stop_index) & (order[same + d] < stop_index))
    return np.concatenate(keys), np.concatenate(inner)


def keys_of(tokens: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """(keys, kinds) of a set: PROBE where it may be the larger one only, INDEX the smaller one only, or BOTH.

    Sets too small to link with any but their equals have none.
    """
    n = len(tokens)
    larger = ALIKE * n // PERCENT
    if larger == n and lacking(n)[0] == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8)
    rare, often = frequent.split(tokens)
    lacks, lacks_index = lacking(n)
    band = n.bit_length()
    keys, inner = prefix_keys(rare, often, band, lacks, lacks_index)
    kinds = np.where(inner, BOTH, PROBE).astype(np.int8)
    if larger.bit_length() != band:
        beyond, _ = prefix_keys(rare, often, band + 1, lacks_index, lacks_index)
        keys, kinds = np.concatenate([keys, beyond]), np.concatenate([kinds, np.full(len(beyond), INDEX, np.int8)])
    return keys, kinds


def signatures(docs: DataFrame, frequent: Frequent) -> DataFrame:
    """(key, h1, h2, n, kind) of all documents; equal sets mostly once for each task."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Remembered()
        for batch in batches:
            parts = []
            for _, tokens in shingle_sets(batch.column("text")):
                if not len(tokens):
                    continue
                h = set_hashes(tokens)
                if seen((int(h[0]), int(h[1]))):
                    continue
                keys, kinds = keys_of(tokens, sent.value)
                if len(keys):
                    parts.append((keys, np.full(len(keys), h[0]), np.full(len(keys), h[1]), np.full(len(keys), len(tokens), np.int32), kinds))
                if len(parts) >= KEYED:
                    yield _keyed(parts)
                    parts = []
            if parts:
                yield _keyed(parts)

    return docs.select("text").mapInArrow(run, "key long, h1 long, h2 long, n int, kind tinyint")


def _keyed(parts: list[tuple]) -> pa.RecordBatch:
    key, h1, h2, n, kind = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n), pa.array(kind)], names=["key", "h1", "h2", "n", "kind"])


def shared_keys(docs: DataFrame, frequent: Frequent) -> DataFrame:
    """(key, id, n, kind) of keys that two different sets or more have, one of them as the smaller one; id is the set's hash.

    Keys are aggregated on the map side, so a hot one arrives as a row for each
    task; its documents meet it in a merge join, whose partitions AQE can split.
    """
    told = written(signatures(docs, frequent), "signatures")
    used = told.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most"), F.max("kind").alias("kinds")).filter("least < most and kinds > 0").select(F.col("key").alias("used"))
    live = told.join(used.hint("merge"), told.key == used.used, "left_semi").select("key", F.struct("h1", "h2").alias("id"), "n", "kind")
    live = written(live, "buckets")
    discarded(told)
    return live


def _with_leading(live: DataFrame) -> DataFrame:
    """(id, n, keys, leading, beyond) for each set of live: its keys with their kinds once each, and the first LEADING of those of kind BOTH and of kind INDEX."""
    sets = live.groupBy("id").agg(F.min("n").alias("n"), F.sort_array(F.collect_set(F.struct("key", "kind"))).alias("keys"))
    first = lambda kind: F.slice(F.transform(F.filter("keys", lambda k: k["kind"] == kind), lambda k: k["key"]), 1, LEADING)
    return sets.withColumns({"leading": first(BOTH), "beyond": first(INDEX)})


def _needed(doc_ids: DataFrame) -> np.ndarray:
    """A table of SLOTS bits with those of doc_ids set, gathered as words by executors."""
    slot = _slot(F.col("doc_id"))
    words = doc_ids.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(SLOTS // 64, np.int64)
    table[np.asarray(words.column("at"))] = np.asarray(words.column("bits"))
    return table.view(np.uint64)


def _slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SLOTS))


def token_sets(docs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(id, tokens) of the documents doc_ids, once for each id, and of a few others whose hashes fall on the same bits."""
    sent = docs.sparkSession.sparkContext.broadcast(_needed(doc_ids))  # SLOTS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Remembered()
        for batch in batches:
            slot = np.asarray(batch.column("slot"))
            wanted = (sent.value[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            if not wanted.any():
                continue
            held, size = [], 0
            for _, tokens in shingle_sets(batch.column("text").filter(pa.array(wanted))):
                if not len(tokens) or seen(h := tuple(int(x) for x in set_hashes(tokens))):
                    continue
                held.append((h, tokens))
                size += len(tokens)
                if size >= CHUNK:
                    yield _sets(held)
                    held, size = [], 0
            if held:
                yield _sets(held)

    rows = docs.select("text", _slot(F.col("doc_id")).alias("slot")).mapInArrow(run, StructType([StructField("h1", LongType()), StructField("h2", LongType()), StructField("tokens", ArrayType(LongType()))]))
    return rows.groupBy(F.struct("h1", "h2").alias("id")).agg(F.any_value("tokens").alias("tokens"))


def _sets(held: list[tuple]) -> pa.RecordBatch:
    h = np.array([h for h, _ in held], np.uint64).view(np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in held])]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([t for _, t in held]).view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), tokens], names=["h1", "h2", "tokens"])


def _differ_at_most(n: Column, m: Column) -> Column:
    """Tokens in one only of two linked sets of n and m, at most."""
    return n + m - 2 * F.ceil(PERCENT * (n + m) / (ALIKE + PERCENT))


def _differing(x: Column, y: Column) -> Column:
    """Bits that differ between two sketches, the larger one halved: sizes of sets that may link are within a factor of two."""
    xor = lambda a, b: a.bitwiseXOR(b)
    half = lambda s: F.zip_with(F.slice(s, F.lit(1), (F.size(s) / 2).cast("int")), F.slice(s, (F.size(s) / 2).cast("int") + 1, (F.size(s) / 2).cast("int")), xor)
    folded = lambda s, other: F.when(F.size(s) > F.size(other), half(s)).otherwise(s)
    return F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n)


def _may_link(a: DataFrame, rest: DataFrame, also: Column) -> DataFrame:
    """Rows of rest joined with those of a(of, a, n_a, part_a, folded words) in their bucket that are smaller, in another component, and may link by size and sketch; also holds for them, and is looked at last."""
    met = rest.filter(F.col("kind") <= BOTH).join(a.hint("merge"), F.col("key") == F.col("of"))
    differ = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"{f}_a"))) for f in FOLDED), F.lit(0))
    met = met.filter("(n > n_a or (n = n_a and id > a)) and coalesce(part, id) <> coalesce(part_a, a)").filter(F.col("n") * PERCENT <= F.col("n_a") * ALIKE)
    return met.filter(differ <= _differ_at_most(F.col("n_a").cast("long"), F.col("n").cast("long"))).filter(also)


def _nearest(buckets: DataFrame, shift: float) -> DataFrame:
    """(a, b): for each set one that is the first of about its size in a bucket of both and may link with it; a row for each set at most.

    Sizes are told apart by powers of ALIKE_SIZES, moved by shift. Of large
    sets only a share of the keys is looked at, about as many as small sets
    have: what this misses is left to the rounds.
    """
    band = F.floor(F.log2("n")).cast("int") + 1
    some = buckets.filter(F.pmod("key", F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(band - FEW_KEYS, F.lit(0)))) == 0)
    some = some.withColumn("about", F.floor(F.log("n") / F.log(F.lit(ALIKE_SIZES)) + shift))
    first = some.filter(F.col("kind") >= BOTH).groupBy(F.col("key").alias("of"), F.col("about").alias("about_a")).agg(F.min(F.struct("n", "id", "part", *FOLDED)).alias("m"))
    first = first.select("of", "about_a", F.col("m.id").alias("a"), F.col("m.n").alias("n_a"), F.col("m.part").alias("part_a"), *[F.col(f"m.{f}").alias(f"{f}_a") for f in FOLDED])
    return _may_link(first, some, F.col("about") == F.col("about_a")).groupBy("id").agg(F.min(F.struct("n_a", "a")).alias("m")).select("m.a", F.col("id").alias("b"))


def _first(buckets: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, last): (a, b) of the first size smaller sets of each bucket with larger ones of it that may link; and the last of those first, by key.

    Near copies share hundreds of keys. Two sets with a common key among their
    leading ones are told in the bucket of the least such key only. They meet
    there in this round or another, or that bucket has become one component.
    """
    order = Window.partitionBy("key").orderBy("n", "id")
    first = buckets.filter(F.col("kind") >= BOTH).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)
    first = written(first.select(F.col("key").alias("of"), F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("part").alias("part_a"), F.concat("leading", "beyond").alias("leading_a"), *[F.col(f).alias(f"{f}_a") for f in FOLDED]), "first")
    met_at = F.array_min(F.array_intersect("leading_a", "leading"))
    return _may_link(first, buckets, F.coalesce(met_at, "key") == F.col("key")).select("a", F.col("id").alias("b")).distinct(), first.groupBy("of").agg(F.max(F.struct("n_a", "a")).alias("last"))


def _candidates(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """pairs(a, b) that may link by their whole sketches, with their sizes and documents."""
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "size", "sketch")]).hint("merge"), side)
    close = pairs.filter(_differing(F.col("sketch_a"), F.col("sketch_b")) <= _differ_at_most(F.col("size_a"), F.col("size_b")))
    return written(close.select("a", "b", "size_a", "size_b", "doc_id_a", "doc_id_b"), "candidates")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs that link, by their whole sets."""
    ids = pairs.select(F.col("doc_id_a").alias("doc_id")).union(pairs.select("doc_id_b"))
    sets = token_sets(docs, ids)
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tokens_b")).hint("merge"), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("tokens_a")).hint("merge"), "a")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.filter(ALIKE * shared >= PERCENT * (F.col("size_a") + F.col("size_b") - shared)).select(F.col("a").alias("u"), F.col("b").alias("v"))


class _Links:
    """The links found so far, and for each set that has some a set of its component as label.

    Between rounds labels needn't be the same in all of a component: each round
    draws together what is two links of labels apart, and only at the end
    components are told. Sets of one label are of one component at any time.
    """

    def __init__(self, docs: DataFrame, facts: DataFrame) -> None:
        self.docs, self.facts = docs, facts
        self.found: list[DataFrame] = []
        self.labels: DataFrame | None = None

    def add(self, pairs: DataFrame) -> None:
        candidates = _candidates(pairs, self.facts)
        if not candidates.isEmpty():
            links = written(_verified(self.docs, candidates), "links")
            if links.isEmpty():
                discarded(links)
            else:
                self.found.append(links)
                self._draw_together()
        discarded(candidates)

    def _across(self) -> DataFrame:
        """(u, v): the links between different labels, in both directions."""
        links = self.found[0]
        for more in self.found[1:]:
            links = links.union(more)
        for side in ("u", "v") if self.labels is not None else ():
            label = self.labels.select(F.col("node").alias("of"), F.col("root").alias("label"))
            links = links.join(label.hint("merge"), F.col(side) == F.col("of"), "left").withColumn(side, F.coalesce("label", side)).drop("of", "label")
        links = links.filter("u <> v")
        return links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()

    def _relabelled(self, roots: DataFrame) -> DataFrame:
        """The labels after each label that is a node of roots(node, root) became its root there; sets without a label yet are nodes of their own."""
        if self.labels is None:
            return roots
        to = roots.select(F.col("node").alias("at"), F.col("root").alias("to"))
        moved = self.labels.join(to.hint("merge"), F.col("root") == F.col("at"), "left").select("node", F.coalesce("to", "root").alias("root"))
        return moved.union(roots.join(self.labels.select("node").hint("merge"), "node", "left_anti"))

    def _draw_together(self) -> None:
        """Each label becomes the least within two links of it."""
        across = written(self._across(), "across")
        near = written(across.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "near")
        further = written(across.join(near.hint("merge"), F.col("v") == F.col("k")).groupBy("u").agg(F.min("m").alias("root")).withColumnRenamed("u", "node"), "further")
        before, self.labels = self.labels, written(self._relabelled(further), "labels")
        discarded(across, near, further, *([before] if before is not None else []))

    def rooted(self) -> DataFrame | None:
        """(node, root) of the components; None without links."""
        if self.labels is None:
            return None
        across = written(self._across(), "across")
        return self.labels if across.isEmpty() else self._relabelled(components(across))

    def still(self, buckets: DataFrame) -> DataFrame:
        """buckets with the labels of their sets as part (null: a set of its own), without those that are of one label or have no smaller set left."""
        rest = buckets
        if self.labels is not None:
            rest = rest.drop("part").join(self.labels.hint("merge"), rest.id == self.labels.node, "left").withColumn("part", F.col("root")).drop("node", "root")
        rest = written(rest, "rest")
        alive = rest.groupBy("key").agg(F.min(own := F.coalesce("part", "id")).alias("p"), F.max(own).alias("q"), F.max("kind").alias("k")).filter(f"p <> q and k >= {BOTH}").select(F.col("key").alias("of"))
        left = written(rest.join(alive.hint("merge"), F.col("key") == F.col("of"), "left_semi"), "buckets")
        discarded(rest)
        return left


def linked_sets(docs: DataFrame, facts: DataFrame, frequent: Frequent) -> DataFrame | None:
    """(node, root) of sets that link with others; root names the component. None if there are no links.

    First each set is compared with one other of about its size for each of
    NEAREST, which makes groups of near copies components of few pairs. Then, in each round, the smallest sets of each bucket are compared with the
    rest of it, unless both are in one component already. What a round has
    compared leaves the bucket, and buckets of one component go, so groups of
    near copies never give all their pairs.
    """
    links = _Links(docs, facts)
    live = shared_keys(docs, frequent)
    facts = facts.select("id", *FOLDED)
    sets = _with_leading(live).join(facts.hint("merge"), "id")
    buckets = written(sets.withColumn("k", F.explode("keys")).select("id", "k.key", "n", "k.kind", "leading", "beyond", *FOLDED, F.lit(None).cast(facts.schema["id"].dataType).alias("part")), "buckets")
    discarded(live)
    size = FIRST_ROUND
    for shift in NEAREST:
        links.add(_nearest(buckets, shift))
        left = links.still(buckets)
        discarded(buckets)
        buckets = left
    while not buckets.isEmpty():
        pairs, last = _first(buckets, size)
        links.add(pairs)
        rest = buckets.join(last.hint("merge"), F.col("key") == F.col("of")).filter("n > last.n_a or (n = last.n_a and id > last.a)").drop("of", "last")
        left = links.still(rest)
        discarded(buckets)
        buckets, size = left, size * GROWTH
    return links.rooted()


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text).

    A document's set are its distinct shingles of SHINGLE words in lower case
    (A to Z); a text of fewer words is one shingle, a null text or one without
    words has none and is linked with nothing. Documents link when ALIKE times
    the intersection is at least PERCENT times the union, and component_id is
    the smallest doc_id that links reach. Null ids are larger than any other; a
    component without ids has none. Repeated rows get equal results. Equal sets
    are one node. Texts of any length are read whole. Other columns are ignored,
    and no rows give no rows.
    """
    described_rows = written(described(docs), "described")
    prints = described_rows.filter("n is not null").drop("token", "many")
    total = prints.agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT, -(-total // MOST_FREQUENT))
    often = described_rows.filter("token is not null").groupBy("token").agg(F.sum("many").alias("many")).filter(F.col("many") >= least).toArrow()  # at most MOST_FREQUENT: each is in so many documents
    frequent = Frequent(np.asarray(often.column("token").combine_chunks()).astype(np.int64).view(np.uint64), np.asarray(often.column("many").combine_chunks()))
    facts = written(
        prints.filter("n > 0").groupBy(F.struct("h1", "h2").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("size"), F.any_value("sketch").alias("sketch"), *[F.min(F.col("folded")[i]).alias(f) for i, f in enumerate(FOLDED)]),
        "facts",
    )
    named = facts.select("id", "doc_id", "copies")
    rooted = linked_sets(docs, facts, frequent)
    if rooted is not None:
        least_of = rooted.join(named.hint("merge"), rooted.node == named.id).groupBy("root").agg(F.min("doc_id").alias("shared")).withColumnRenamed("root", "r")
        by_node = rooted.join(least_of.hint("merge"), rooted.root == F.col("r")).select("node", "shared")
        named = named.join(by_node.hint("merge"), named.id == by_node.node, "left").filter("copies > 1 or node is not null").select("id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("shared")).alias("least"))
    else:
        named = named.filter("copies > 1").select("id", F.col("doc_id").alias("least"))
    named = written(named, "named")
    rows = prints.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.struct("h1", "h2")).alias("of"))
    return rows.join(named.hint("merge"), rows["of"] == named.id, "left").select("doc_id", "n_shingles", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {SHINGLE} THEN [array_to_string(words, ' ')]
      ELSE list_distinct([array_to_string(words[i : i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(words) - {SHINGLE - 2})]) END AS tokens FROM w),
t AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS token FROM s),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM t AS a JOIN t AS b ON a.token = b.token AND a.doc_id < b.doc_id AND {ALIKE} * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY u, v, a.n, b.n HAVING {ALIKE} * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT DISTINCT u AS doc_id, u AS other FROM both_ways UNION SELECT reach.doc_id, v FROM reach JOIN both_ways ON u = other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(tokens) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id FROM s LEFT JOIN least_of ON least_of.doc_id = s.doc_id
"""
