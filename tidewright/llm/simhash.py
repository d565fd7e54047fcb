"""SimHash near-dedup with keys from the binary Golay code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewright.operators.components import components
from tidewright.storage import discarded, written

SHINGLE = 3
MOST_BITS = 3
SEED = 42

#: Lengths of the fingerprint's segments (two Golay words and a rest of two halves), and the generator polynomial of the (23, 12) code.
SEGMENTS = (23, 23, 18)
GENERATOR = 0b110001110101

#: Buckets up to this many fingerprints are compared by shifted arrays, larger ones by a search that drops what it has reached.
SMALL_BUCKET = 6
#: Larger buckets than this are searched by the four quarters of a fingerprint, one of which two within 3 bits share.
WIDE_BUCKET = 512


def fingerprint(text: str | None) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words give 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


class Golay:
    """The perfect (23, 12) code: every 23-bit word is within 3 bits of one codeword.

    near[s] are the codewords, relative to the nearest one, that decode a word of
    syndrome s or one of its 23 neighbours: 1 to 6 of them. Two words within 2
    bits have a neighbour in common, so they share one of these codewords.
    """

    def __init__(self) -> None:
        message = np.arange(1 << 12, dtype=np.int64)
        remainder = message << 11
        for bit in range(22, 10, -1):
            remainder = np.where(remainder >> bit & 1, remainder ^ (GENERATOR << (bit - 11)), remainder)
        self.remainder = remainder
        flips = [0, *(1 << i for i in range(23))]
        errors = {0} | {a | b | c for a in flips for b in flips for c in flips if a | b | c}
        self.error = np.zeros(1 << 11, np.int64)
        for e in errors:
            self.error[self.syndrome(np.int64(e))] = e
        self.near = np.zeros((1 << 11, 6), np.int64)
        self.count = np.zeros(1 << 11, np.int64)
        for s in range(1 << 11):
            found = sorted({int(self.codeword(self.error[s] ^ flip)) for flip in flips})
            self.near[s, : len(found)] = found
            self.count[s] = len(found)

    def syndrome(self, word):
        return self.remainder[word >> 11] ^ (word & 0x7FF)

    def codeword(self, word):
        """Index of the nearest codeword: its 12 message bits."""
        return (word ^ self.error[self.syndrome(word)]) >> 11

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An (n, 6) array of codeword indices and a mask of those that count."""
        at = self.syndrome(words)
        return self.codeword(words)[:, None] ^ self.near[at], np.arange(6) < self.count[at][:, None]


_GOLAY: list[Golay] = []


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, key) so that any two fingerprints within 3 bits share a key.

    With a, b, c differing bits in the three segments and a + b + c <= 3:
    a, b <= 2 and c <= 1 leaves a half of the third segment equal (two Golay
    keys and that half); c >= 2 leaves the first or second segment equal and at
    most 1 bit in the other (that segment and a Golay key); a = 3 or b = 3
    leaves the other two segments equal.
    """
    if not _GOLAY:
        _GOLAY.append(Golay())
    golay = _GOLAY[0]
    fps = fps.astype(np.uint64)
    first = (fps & np.uint64((1 << 23) - 1)).astype(np.int64)
    second = (fps >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64)
    third = (fps >> np.uint64(46)).astype(np.int64)
    k1, m1 = golay.keys(first)
    k2, m2 = golay.keys(second)
    at, keys = [], []

    def add(kind: int, values: np.ndarray, mask: np.ndarray) -> None:
        where, _ = np.nonzero(mask)
        at.append(where)
        keys.append(values[mask] << 3 | kind)

    pair = (k1[:, :, None] << 12 | k2[:, None, :]).reshape(len(fps), 36)
    both = (m1[:, :, None] & m2[:, None, :]).reshape(len(fps), 36)
    add(0, pair << 9 | (third & 0x1FF)[:, None], both)
    add(1, pair << 9 | (third >> 9)[:, None], both)
    add(2, first[:, None] << 12 | k2, m2)
    add(3, second[:, None] << 12 | k1, m1)
    one = np.ones((len(fps), 1), bool)
    add(4, (second << 18 | third)[:, None], one)
    add(5, (first << 18 | third)[:, None], one)
    return np.concatenate(at), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            fps = batch.column("fp").slice(i, 4096).to_numpy(zero_copy_only=False)
            at, keys = bucket_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at])], names=["key", "fp"])


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join whatever fps (distinct) can reach through steps of 3 bits, one less than each such group has.

    A fingerprint is compared with those not reached yet only, so a tight group
    of any size costs about its size and never gives all its pairs.
    """
    links = []
    rest = fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            close = np.bitwise_count(rest ^ x) <= MOST_BITS
            if close.any():
                hits = rest[close]
                links += [(int(x), int(h)) for h in hits]
                todo += list(hits)
                rest = rest[~close]
    return links


def bucket_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """spanning_links() of a bucket of any size: beyond WIDE_BUCKET, of those with an equal quarter, so that fingerprints far apart aren't compared."""
    if len(fps) <= WIDE_BUCKET:
        return spanning_links(fps)
    links = []
    for quarter in range(4):
        part = fps >> np.uint64(16 * quarter) & np.uint64(0xFFFF)
        order = np.argsort(part, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0, [True]]))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a > 1:
                links += spanning_links(fps[order[a:b]])
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the buckets in rows sorted by (key, fp); a bucket may go over batches."""

    def within(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        runs = np.diff(edge)
        size = np.repeat(runs, runs)
        out = []
        for d in range(1, SMALL_BUCKET):
            near = (size[:-d] > d) & (size[:-d] <= SMALL_BUCKET) & (keys[:-d] == keys[d:])
            near &= np.bitwise_count(fps[:-d] ^ fps[d:]) <= MOST_BITS
            out.append(np.stack([fps[:-d][near], fps[d:][near]], 1))
        for i in np.flatnonzero(runs > SMALL_BUCKET):
            if links := bucket_links(fps[edge[i] : edge[i + 1]]):
                out.append(np.array(links, np.uint64))
        found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.uint64)
        if not len(found):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in (0, 1)], names=["u", "v"])

    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(keys) and keys[0] != keys[-1]:
            cut = int(np.searchsorted(keys, keys[-1]))
            if out := within(keys[:cut], fps[:cut]):
                yield out
            keys, fps = keys[cut:], fps[cut:]
    if len(keys) > 1 and (out := within(keys, fps)):
        yield out


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) of fingerprints within 3 bits; all links within a bucket of few, a spanning set in larger ones."""
    keyed = distinct.select("fp").mapInArrow(_keyed, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links, "u long, v long").distinct()


def least_of_components(prints: DataFrame, order: Column) -> DataFrame:
    """(of, least): the least order among the rows of the component of fingerprint of; fingerprints of one row without links are left out.

    Nodes get about 70 keys each; the buckets of a key hold distinct
    fingerprints only. The rows of a large component meet its least order in one
    join by their root, which AQE can split as both sides are plain shuffles of
    written tables; they are dealt by node again before they are written, so that
    no later task reads a component. The result is written, a scan of its
    own, so that AQE can split a hot fingerprint in the join with it. Joins are
    hinted to merge: no side grows into a broadcast.
    """
    nodes = prints.groupBy("fp").agg(F.min(order).alias("own"), F.count(F.lit(1)).alias("n"))
    nodes = written(nodes, "nodes")
    found = written(links(nodes), "links")
    rooted = components(found)
    linked = rooted.join(nodes.hint("merge"), rooted.node == nodes.fp).select("node", "root", "own")
    roots = written(linked.groupBy(F.col("root").alias("of")).agg(F.min("own").alias("shared")), "roots")
    by_node = written(rooted.join(roots.hint("merge"), rooted.root == roots["of"]).select("node", "shared").repartition("node"), "by-node")
    named = (
        nodes.join(by_node.hint("merge"), nodes.fp == by_node.node, "left")
        .filter("n > 1 or node is not null")
        .select(F.col("fp").alias("of"), F.when(F.col("node").isNotNull(), F.col("shared")).otherwise(F.col("own")).alias("least"))
    )
    named = written(named, "components-named")
    discarded(nodes, found, roots, by_node)
    return named


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id for each row of docs.

    Equal fingerprints become one node first, so copies cost nothing more.
    component_id is the smallest doc_id that can be reached
    through links of at most 3 bits. Null and wordless texts have fingerprint 0
    and are linked like any other. A null doc_id is larger than any other; if a
    component has no other, its id is null. Repeated rows get equal results.
    Other columns are ignored, and no rows give no rows.
    """
    prints = written(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    named = least_of_components(prints, F.col("doc_id")).withColumnRenamed("least", "component")
    return prints.join(named.hint("merge"), prints.fp == named["of"], "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each component of near_copies(): that of its smallest doc_id.

    A null doc_id is larger than any other. Of rows that share the smallest
    doc_id, null or not, that of the least hash over all columns stays. Each
    row is judged by its own fingerprint: rows are numbered and written with it,
    and those that go are looked up by number, so other rows with an equal or
    null doc_id aren't touched.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc_id, text = (names[docs.columns.index(n)] for n in ("doc_id", "text"))
    tie = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in names])
    numbered = plain.select("*", tie.alias("tie"), F.monotonically_increasing_id().alias("number"))

    def with_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(text)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))], names=[*batch.schema.names, "fp"])

    schema = StructType([*numbered.schema, StructField("fp", LongType())])
    rows = written(numbered.mapInArrow(with_prints, schema), "fingerprinted")
    prints = rows.select("fp", "number", F.struct(F.col(doc_id).isNull().alias("without"), doc_id, "tie", "number").alias("order"))
    least = least_of_components(prints, F.col("order"))
    gone = prints.join(least, prints.fp == least["of"]).filter(F.col("number") != F.col("least.number")).select(F.col("number").alias("gone"))
    stay = rows.join(gone, rows.number == gone["gone"], "left_anti")
    return stay.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
