"""Substring dedup: relative Lempel-Ziv parsing against all earlier blocks of the corpus.

Every document is cut into blocks whose limits depend on nearby words only, so
that a passage is cut alike wherever it stands. The blocks are the index: of
equal ones, the earliest is the reference block, known by its document and
place. A document's blocks that equal an earlier one match it there; where a
passage ends inside a block no block is equal, so there, at the ends of
factors, the windows of the length asked for are looked up one by one. Matches
that continue each other in the same reference are one longer match, and a
document is parsed greedily from left to right: at each word the match that
reaches furthest gives the next factor (place, length, reference document and
place), and words that no match covers are literals. All matches are at least a
window long, so what factors cover are the duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.textkit import hashed_rows, mix64, powers, text_steps, words_of
from tidewright.storage import written

#: Words of a window: the least length of a factor that counts.
WINDOW = 20
#: Words of an anchor. Each window has one: that of its WINDOW - ANCHOR + 1 runs of ANCHOR words with the least hash.
ANCHOR = 8
REACH = WINDOW - ANCHOR + 1
#: Blocks that a task gathers before it combines equal ones.
COMBINE = 400_000

BASES = (0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB4F)
LAST_ID = (1 << 63) - 1

COPY, SHARED, SINGLE = 0, 1, 2


class Rolling:
    """Hashes of any range of a sequence of word hashes in constant time, from sums of powers modulo 2**64."""

    def __init__(self, hashes: np.ndarray, base: int) -> None:
        n = len(hashes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, n), dtype=np.uint64)])
        self.back = powers(pow(base, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(BASES[0]))


def least_in_windows(ranks: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of every width consecutive ranks, the leftmost of equals."""

    def better(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(ranks[left] <= ranks[right], left, right)

    at, span = np.arange(len(ranks)), 1
    while span * 2 <= width:
        at = better(at[:-span], at[span:])
        span *= 2
    return better(at[: len(at) - (width - span)], at[width - span :]) if span < width else at


def blocks(hashes: np.ndarray, of: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of documents whose words are hashes[of[i]:of[i + 1]].

    A block covers the consecutive windows that share an anchor: it has its
    document's row, its first word a, its number of windows n (so n + WINDOW - 1
    words), the anchor's hash and a 128-bit id of its words.
    """
    none = np.zeros(0, np.int64)
    out = {"row": none, "a": none, "n": none, "anchor": none.view(np.uint64), "id1": none.view(np.uint64), "id2": none.view(np.uint64)}
    if len(hashes) < WINDOW:
        return out
    first, second = (Rolling(hashes, b) for b in BASES)
    begin = np.arange(len(hashes) - ANCHOR + 1)
    ranks = first.of(begin, begin + ANCHOR)
    row_of = np.repeat(np.arange(len(of) - 1), np.diff(of))
    starts = np.arange(len(hashes) - WINDOW + 1)
    starts = starts[starts + WINDOW <= of[row_of[starts] + 1]]
    if not len(starts):
        return out
    anchors = least_in_windows(ranks, REACH)[starts]
    runs = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    n = np.diff(np.concatenate([runs, [len(starts)]]))
    a = starts[runs]
    end = a + n + WINDOW - 1
    return {"row": row_of[a], "a": a - of[row_of[a]], "n": n, "anchor": ranks[anchors[runs]], "id1": first.of(a, end), "id2": second.of(a, end)}


def _combined(docs: np.ndarray, b: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Blocks of one task's part: all but the first of equal ids are copies already; where an anchor comes again, its blocks need not meet others to be known as shared.

    Only one block of each anchor goes by the anchor in the next shuffle, the
    rest spread evenly, so that a passage of half the corpus makes no hot key.
    The rows are the largest that are shuffled, so they are packed: place is a,
    n and the status, an anchor is written where the key isn't it only. A copy
    needs neither anchor nor ids: there stand the document and the place of the
    last block before it that it equals, and copies that continue each other
    there are one row, of the sum of their windows.
    """
    order = np.lexsort((b["a"], docs, b["id2"], b["id1"]))
    docs, b = docs[order], {k: v[order] for k, v in b.items()}
    new = np.concatenate([[True], (b["id1"][1:] != b["id1"][:-1]) | (b["id2"][1:] != b["id2"][:-1])])
    listed = ~new & np.concatenate([[False], (docs[1:] == docs[:-1]) & (b["a"][1:] == b["a"][:-1])])
    run = np.maximum.accumulate(np.where(listed, 0, np.arange(len(docs))))
    again, before = ~new & new[run], run - 1
    status = np.where(new, SINGLE, COPY)
    _, place, times = np.unique(b["anchor"], return_inverse=True, return_counts=True)
    shared = times[place] > 1
    status[new & shared] = SHARED
    spread = mix64(docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b["a"].astype(np.uint64))
    key = np.where(status == SINGLE, b["anchor"], spread)
    fresh = np.flatnonzero(status == SHARED)
    _, lead = np.unique(b["anchor"][fresh], return_index=True)
    key[fresh[lead]] = b["anchor"][fresh[lead]]
    apart = (status == SHARED) & (key != b["anchor"])
    columns = [key, docs, b["a"] << 34 | b["n"] << 2 | status, np.where(apart, b["anchor"], 0).astype(np.uint64), b["id1"], b["id2"]]
    kept = status != COPY
    copied = np.flatnonzero(~kept & ~again)
    copied = copied[np.lexsort((b["a"][copied], docs[copied]))]
    doc, first, n, ref, ref_a = docs[copied], b["a"][copied], b["n"][copied], docs[before[copied]], b["a"][before[copied]]
    same = (doc[1:] == doc[:-1]) & (first[1:] == first[:-1] + n[:-1]) & (ref[1:] == ref[:-1]) & (ref_a[1:] - ref_a[:-1] == n[:-1])
    cut = np.flatnonzero(np.concatenate([[True], ~same])) if len(doc) else np.zeros(0, np.int64)
    run = np.add.reduceat(n, cut) if len(cut) else n
    doc, first, ref, ref_a = doc[cut], first[cut], ref[cut], ref_a[cut]
    even = mix64(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + first.astype(np.uint64))
    factors = [even, doc, first << 34 | run << 2 | COPY, ref, even, ref_a]
    signed = lambda v: v.view(np.int64) if v.dtype == np.uint64 else v
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([signed(c)[kept], signed(f)])) for c, f in zip(columns, factors, strict=True)], names=["key", "doc", "place", "anchor", "id1", "id2"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, parts, held = [], [], 0
    for batch in batches:
        ids = batch.column("key").to_numpy(zero_copy_only=False)
        for first, end, raw, offsets in text_steps(batch.column("text")):
            found = blocks(*hashed_rows(raw, offsets))
            if len(found["a"]):
                docs.append(ids[first:end][found.pop("row")])
                parts.append(found)
                held += len(docs[-1])
            if held >= COMBINE:
                yield _combined(np.concatenate(docs), {k: np.concatenate([p[k] for p in parts]) for k in parts[0]})
                docs, parts, held = [], [], 0
    if held:
        yield _combined(np.concatenate(docs), {k: np.concatenate([p[k] for p in parts]) for k in parts[0]})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit ids of the windows in the given blocks of each text; equal ones within a task's part are copies of the first, and say where it is."""
    for batch in batches:
        ids = batch.column("key").to_numpy(zero_copy_only=False)
        spans = batch.column("spans")
        found = []
        for first, end, raw, offsets in text_steps(batch.column("text")):
            hashes, of = hashed_rows(raw, offsets)
            one, two = (Rolling(hashes, b) for b in BASES)
            at, doc = [], []
            for row in range(first, end):
                packed = np.unique(np.asarray(spans[row].values.to_numpy(zero_copy_only=False), np.int64))
                a, n = packed >> 32, packed & 0xFFFFFFFF
                inside = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                inside = np.unique(inside[inside + WINDOW <= of[row - first + 1] - of[row - first]])
                at.append(inside + of[row - first])
                doc.append(np.stack([np.full(len(inside), ids[row]), inside], 1))
            at, doc = np.concatenate(at), np.concatenate(doc)
            found.append((one.of(at, at + WINDOW), two.of(at, at + WINDOW), doc[:, 0], doc[:, 1]))
        w1, w2, docs, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((s, docs, w2, w1))
        w1, w2, docs, s = w1[order], w2[order], docs[order], s[order]
        new = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]) if len(w1) else np.zeros(0, bool)
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        keep = new | (docs != docs[head]) | (s != s[head])
        w1 = np.where(new, w1, mix64(docs.astype(np.uint64) * np.uint64(BASES[1]) + s.astype(np.uint64)))
        columns = {"w1": w1.view(np.int64), "w2": np.where(new, w2, 0).astype(np.uint64).view(np.int64), "doc": docs, "a": s.astype(np.int32)}
        refs = {"ref": pa.array(docs[head][keep], mask=new[keep]), "ref_a": pa.array(s[head][keep].astype(np.int32), mask=new[keep])}
        yield pa.RecordBatch.from_arrays([*[pa.array(v[keep]) for v in columns.values()], *refs.values()], names=[*columns, *refs])


def packed(a: Column, n: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(n.cast("long"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key: the id that orders documents; a null id comes last."""
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def matches(docs: DataFrame) -> DataFrame:
    """(doc, a, n, ref, ref_a): n windows from word a on, in document doc (the key), that start earlier too: in document ref from word ref_a on.

    Blocks meet by their anchors in one shuffle and those of anchors that come
    more than once, a small part, by their ids in another. What equals a
    reference block is known then but for anchors in different blocks, at the
    ends of passages: the windows of their first blocks are compared in a third.
    """
    source = keyed(docs)
    cut = source.select("key", "text").mapInArrow(_cut, "key long, doc long, place long, anchor long, id1 long, id2 long")
    status = F.col("place").bitwiseAND(3)
    met = cut.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter((status != SINGLE) | (F.col("times") > 1)).drop("times")
    a, n = F.shiftright("place", 34), F.shiftright("place", 2).bitwiseAND((1 << 32) - 1)
    earliest = F.first(F.struct("doc", a.alias("a"))).over(Window.partitionBy("id1", "id2").orderBy("doc", a))
    known = status == COPY
    placed = met.withColumn("earliest", earliest).select(
        "doc",
        a.cast("int").alias("a"),
        n.cast("int").alias("n"),
        F.when(F.col("anchor") == 0, F.col("key")).otherwise(F.col("anchor")).alias("anchor"),
        F.when(known, F.col("anchor")).otherwise(F.col("earliest.doc")).alias("ref"),
        F.when(known, F.col("id2")).otherwise(F.col("earliest.a")).cast("int").alias("ref_a"),
    )
    told = written(placed, "blocks")
    is_reference = (F.col("ref") == F.col("doc")) & (F.col("ref_a") == F.col("a"))
    firsts = told.filter(is_reference)
    torn = firsts.groupBy("anchor").count().filter("count > 1").select("anchor")
    spans = firsts.join(torn, "anchor", "left_semi").groupBy("doc").agg(F.collect_list(packed(F.col("a"), F.col("n"))).alias("spans")).withColumnRenamed("doc", "of")
    texts = source.join(spans, source.key == spans["of"]).select("doc_id", "key", "text", "spans")
    windows = texts.mapInArrow(_windows, "w1 long, w2 long, doc long, a int, ref long, ref_a int")
    first = F.first(F.struct("doc", "a")).over(Window.partitionBy("w1", "w2").orderBy("doc", "a"))
    later = windows.withColumn("first", first).select("doc", "a", F.lit(1).alias("n"), F.coalesce("ref", "first.doc").alias("ref"), F.coalesce("ref_a", "first.a").alias("ref_a"))
    return told.select("doc", "a", "n", "ref", "ref_a").union(later).filter(~is_reference)


def parse(n_words: int, a: np.ndarray, n: np.ndarray, ref: np.ndarray, ref_a: np.ndarray) -> np.ndarray:
    """The greedy parse of a document of n_words from its matches: rows (word, length, ref, ref word).

    Matches that overlap or touch at the same distance in the same reference
    are one. From left to right, the match that covers the next word and
    reaches furthest gives a factor up to its end; without one the parse goes on
    where the next match begins.
    """
    if not len(a):
        return np.zeros((0, 4), np.int64)
    end = np.minimum(a + n + WINDOW - 1, n_words)
    order = np.lexsort((a, ref_a - a, ref))
    a, end, ref, shift = a[order], end[order], ref[order], (ref_a - a)[order]
    group = np.cumsum(np.concatenate([[0], (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1])]))
    reach = np.maximum.accumulate(end + group * (n_words + 1)) - group * (n_words + 1)
    head = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (a[1:] > reach[:-1])]))
    a, ref, shift, end = a[head], ref[head], shift[head], reach[np.concatenate([head[1:], [len(reach)]]) - 1]
    order = np.lexsort((ref, -end, a))
    factors, at, furthest, best = [], 0, 0, -1
    starts, ends = a[order].tolist(), end[order].tolist()
    i = 0
    while True:
        while i < len(starts) and starts[i] <= at:
            if ends[i] > furthest:
                furthest, best = ends[i], i
            i += 1
        if furthest > at:
            row = order[best]
            factors.append((at, furthest - at, int(ref[row]), at + int(shift[row])))
            at = furthest
        elif i < len(starts):
            at = starts[i]
        else:
            return np.array(factors, np.int64)


def _parsed(n_words: int, found: pa.StructArray | None) -> np.ndarray:
    """parse() of a document's matches as they are gathered."""
    if found is None:
        return np.zeros((0, 4), np.int64)
    return parse(n_words, *[found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "n", "ref", "ref_a")])


def _covered(n_words: int, factors: np.ndarray) -> np.ndarray:
    """Which words the factors cover."""
    gone = np.zeros(n_words, bool)
    for at, length in factors[:, :2].tolist():
        gone[at : at + length] = True
    return gone


def _factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, rows = [], []
        for key, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("found"), strict=True):
            own = _parsed(len(words_of(text.as_py())), found.values)
            doc += [key] * len(own)
            rows.append(own)
        table = np.concatenate([np.zeros((0, 4), np.int64), *rows])
        refs = pa.array(table[:, 2], mask=table[:, 2] == LAST_ID)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(table[:, 0]), pa.array(table[:, 1]), refs, pa.array(table[:, 3])], names=["doc_id", "word", "n_words", "ref_id", "ref_word"])


def _with_matches(docs: DataFrame, how: str) -> DataFrame:
    found = matches(docs).groupBy("doc").agg(F.collect_list(F.struct("a", "n", "ref", "ref_a")).alias("found")).withColumnRenamed("doc", "of")
    source = keyed(docs)
    return source.join(found, source.key == found["of"], how).select("doc_id", "text", "found")


def factors(docs: DataFrame) -> DataFrame:
    """doc_id, word, n_words, ref_id and ref_word: the factors of docs' relative Lempel-Ziv parse, in no order.

    n_words words from the word-th on (from 0) stand in document ref_id, too,
    from its ref_word-th on, earlier in the order of doc_id and place; words
    without a factor are literals. What is said of rows at without_repeats()
    holds here. The rows of a repeated doc_id are parsed each.
    """
    return _with_matches(docs, "inner").mapInArrow(_factored, "doc_id long, word long, n_words long, ref_id long, ref_word long")


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
            words = words_of(text.as_py())
            n_words.append(len(words))
            if found.is_valid:
                gone = _covered(len(words), _parsed(len(words), found.values))
                words = list(compress(words, (~gone).tolist()))
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"]
        )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _stripped(batches):
        sha = [hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in batch.column("kept_text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def without_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (or, with digest, kept_sha256) for each row of docs.

    A word goes if a window of 20 words that covers it starts earlier as well,
    in a smaller doc_id or before in its own document; windows are those of the
    input. Kept words are joined by one space. Null texts have no words. A null
    doc_id comes after all others. Rows that repeat a doc_id count as one
    document listed more than once: they are no copies of each other, and what
    is found in one of them goes from all. Other columns are ignored; no rows
    give no rows. A text is one task's work, in memory of some 25 bytes for each
    byte of it. Equality of blocks (at most 32 words) and windows is that of
    128-bit hashes of the words' XXH64.
    """
    last = "kept_sha256" if digest else "kept_text"
    return _with_matches(docs, "left").mapInArrow(_digested if digest else _stripped, f"doc_id long, n_words long, n_removed long, {last} string")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, s, row_number() OVER (PARTITION BY md5(array_to_string(w[s:s + 19], ' ')) ORDER BY doc_id, s) AS nth FROM p),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS i FROM g WHERE nth > 1),
gone AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
k AS (
  SELECT x.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY x.i) AS kept
  FROM x ANTI JOIN r ON x.doc_id = r.doc_id AND x.i = r.i GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
