"""Quality rules: counts, and the divergence of a text's histograms from those of its language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.textkit import words_of
from tidewright.storage import written

#: Frequent words of four languages, in natural order.
COMMON = {
    "de": "aber als an auch auf aus bei das dem den der des die ein eine einen er es für hat ich im in ist mit nicht sich sie sind und von war werden wie wird zu zum zur".split(),
    "en": "a and are as at be but by for from had has have he his i in is it not of on or she that the they this to was were which with you".split(),
    "es": "al como con de del el en es ha la las lo los más no o para pero por que se sin sobre su sus un una y ya".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne ou par pas plus pour qu que qui se son sont sur un une".split(),
}
WORDS = sorted({w.encode() for words in COMMON.values() for w in words})
PLACE = {w: i for i, w in enumerate(WORDS)}
TRIM = b".,;:!?\"'()[]"

SYMBOLS = b"#*$%&|<>"

#: Character classes: lower case, upper case, digits, white space, marks of sentences, other ASCII marks, letters beyond ASCII (by their first byte), SYMBOLS.
CLASSES = 8
_CLASS = np.full(256, 5)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_CLASS[list(b".,;:!?\"'()-")] = 4
_CLASS[0xC0:] = 6
_CLASS[list(SYMBOLS)] = 7
_CLASS[0x80:0xC0] = CLASSES  # continuation bytes count nowhere

#: A language's reference leaves out texts that fail the base rules, and those with more symbols for a word or a larger share of capitals among letters than this.
REFERENCE_SYMBOLS, REFERENCE_CAPITALS = 0.05, 0.3

#: A text shorter than this, in words, is judged by the base rules alone; character classes need the first, common words the second.
LEAST_FOR_CLASSES, LEAST_FOR_WORDS = 20, 30
#: The largest Jensen-Shannon distances (square roots of divergences in bits, 0 to 1) from the closest language, and what a text of n words may have more, over n: short texts stray further by chance.
MOST_CLASSES, MOST_WORDS = 0.15, 0.35
SHORT_CLASSES, SHORT_WORDS = 3.8, 3.0

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BINS = CLASSES + len(WORDS) + 1


def repeat_words(ids: np.ndarray) -> int:
    """Words within 5-word windows that come twice or more; ids number the distinct words from 0, so windows compare exactly."""
    if len(ids) < 6:
        return 0
    distinct = int(ids.max()) + 1
    if distinct < 6000:
        keys = ids[:-4].astype(np.int64)
        for k in range(1, 5):
            keys = keys * distinct + ids[k : len(ids) - 4 + k]
    else:
        pairs = np.unique(ids[:-1] * np.int64(distinct) + ids[1:], return_inverse=True)[1]
        fours = np.unique(pairs[:-2] * np.int64(len(ids)) + pairs[2:], return_inverse=True)[1]
        keys = fours[: len(ids) - 4] * np.int64(distinct) + ids[4:]
    _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[place] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[twice] += 1
    edges[twice + 5] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """[n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], the class histogram and the counts of common words (all others last)."""
    raw = text.encode() if text else b""
    words = words_of(text)
    codes = np.frombuffer(raw, np.uint8)
    classes = np.bincount(_CLASS[codes], minlength=CLASSES + 1)[:CLASSES]
    chars = int(classes.sum()) - int(classes[3])
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = Counter(line for line in raw.split(b"\n") if line and line.split())
    dup_lines = sum(lines.values()) - len(lines)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    common = np.zeros(len(WORDS) + 1, np.int64)
    if words:
        times = np.bincount(ids, minlength=len(number))
        for w, n in zip(number, times.tolist(), strict=True):
            common[PLACE.get(w.lower().strip(TRIM), -1)] += n
    return [len(words), chars, symbols, dup_lines, repeat_words(ids)], classes, common


def base_failed(counts: list[int]) -> bool:
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histograms p (one, or a row each) from q, in bits: 0 for equal, 1 for disjoint ones; 1 if one of them is empty."""
    p, q = np.atleast_2d(np.asarray(p, float)), np.asarray(q, float)
    sizes = p.sum(1)
    if not q.sum():
        return np.ones(len(p))
    p, q = p / np.where(sizes, sizes, 1.0)[:, None], q / q.sum()
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1.0) / np.where(m > 0, m, 1.0)), 0.0).sum(1)
    return np.where(sizes > 0, np.sqrt(np.maximum(0.0, (part(p) + part(np.broadcast_to(q, p.shape))) / 2)), 1.0)


def is_typical(counts: list[int], classes: np.ndarray) -> bool:
    """Whether a text may count towards its language's reference."""
    return not base_failed(counts) and counts[2] <= REFERENCE_SYMBOLS * counts[0] and classes[1] <= REFERENCE_CAPITALS * (classes[0] + classes[1] + classes[6])


class References:
    """Histograms of each language with common words, as sums over the corpus."""

    def __init__(self, sums: dict[str, np.ndarray]) -> None:
        self.by_lang = sorted((lang, np.asarray(v[:CLASSES], float), np.asarray(v[CLASSES:], float)) for lang, v in sums.items())

    def passes(self, n_words: np.ndarray, histograms: np.ndarray) -> np.ndarray:
        """Whether each text is close enough to the language whose common words are closest, or too short to say."""
        short = n_words < LEAST_FOR_CLASSES
        if not self.by_lang or not len(n_words):
            return np.ones(len(n_words), bool)
        by_word = np.stack([distance(histograms[:, CLASSES:], common) for _, _, common in self.by_lang])
        by_class = np.stack([distance(histograms[:, :CLASSES], classes) for _, classes, _ in self.by_lang])
        closest, row = by_word.argmin(0), np.arange(len(n_words))
        n = np.maximum(n_words, 1)
        like_class = by_class[closest, row] <= MOST_CLASSES + SHORT_CLASSES / n
        like_word = by_word[closest, row] <= MOST_WORDS + SHORT_WORDS / n
        return short | (like_class & (like_word | (n_words < LEAST_FOR_WORDS)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, histograms, typical = [], [], []
        for text in batch.column("text"):
            own, classes, common = measure(text.as_py())
            counts.append(own)
            histograms.append(np.concatenate([classes, common]).astype(np.int64).tobytes())
            typical.append(is_typical(own, classes))
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), *columns, pa.array(histograms, pa.binary()), pa.array(typical, pa.bool_())], names=["doc_id", "lang", *COUNTS, "histogram", "typical"]
        )


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the counts, the histogram (BINS numbers of 8 bytes) and typical for each row of docs, written: the one pass over texts."""
    schema = ", ".join(["doc_id long", "lang string", *[f"{c} long" for c in COUNTS], "histogram binary", "typical boolean"])
    return written(docs.select("doc_id", "lang", "text").mapInArrow(_measured, schema), "measures")


def _histograms(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("histogram").to_pylist()), np.int64).reshape(-1, BINS)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, histograms = np.array(batch.column("lang").to_pylist(), object), _histograms(batch)
        for lang in set(langs):
            totals[lang] = totals.get(lang, 0) + histograms[langs == lang].sum(0)
    rows = [(lang, i, int(v)) for lang, sums in totals.items() for i, v in enumerate(sums)]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True)) or [[], [], []], (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "place", "n"])


def references(measured: DataFrame) -> References:
    """Sums over all typical documents of the languages with common words; a few numbers for each language and task are shuffled."""
    known = measured.filter(F.col("typical") & F.col("lang").isin(list(COMMON))).select("lang", "histogram")
    rows = known.mapInArrow(_sums, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).collect()
    sums: dict[str, np.ndarray] = {}
    for r in rows:
        sums.setdefault(r["lang"], np.zeros(BINS))[r["place"]] = r["n"]
    return References(sums)


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept for each row of docs.

    References are the summed histograms of all documents of a language; a text
    is compared with the one whose common words are closest, so its own label
    doesn't matter. Texts are read once: what is counted in them is written,
    summed and judged from there. A text is measured whole, one at a time, in
    memory of some 30 times its size. Null and empty texts have no words and
    fail the base rules. Texts below the guards' lengths pass by the base rules
    alone, and so do all if docs has none of the languages. Repeated rows get
    equal results; other columns are ignored; no rows give no rows.
    """
    measured = measures(docs)
    known = docs.sparkSession.sparkContext.broadcast(references(measured))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, repeats = (batch.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
            failed = (n_words < 10) | (100 * repeats > 20 * n_words)
            kept = ~failed & known.value.passes(n_words, _histograms(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in COUNTS], pa.array(failed), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "kept"])

    counted = measured.select("doc_id", *COUNTS, "histogram")
    return counted.mapInArrow(judge, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean")
