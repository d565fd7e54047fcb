"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.textkit import mix64, text_steps, word_bounds, word_hashes

#: Labelled documents that the model is fitted on, at most: those whose hashed ids come first. A fit's bound, not a corpus bound.
SAMPLE = 5_000
#: Indicators of a labelled document reach the driver as positions up to this many, as a bit for each position beyond: at most KINDS * BINS / 8 bytes a document.
MOST_POSITIONS = 4096
#: Each of the four kinds of n-gram (bytes by threes, word shapes by one, two and three) is hashed into this many indicators.
BINS = 1 << 15
KINDS = 4
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 20
#: Every so many-th document of the sample sets the scale of scores and isn't fitted on.
SCALE_PART = 4
THRESHOLD = 0.3
SEED = 11


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first_words: np.ndarray) -> np.ndarray:
    """A small number for the look of each word: its first and last characters, capitals, length, and whether it repeats the word before in its row."""
    upper = (raw >= 65) & (raw <= 90)
    other = (raw < 128) & ~upper & ~((raw >= 97) & (raw <= 122))
    capitals = np.concatenate([[0], np.cumsum(upper)])
    marks = np.concatenate([[0], np.cumsum(other)])
    length = ends - starts
    first, last = raw[starts].astype(np.int64), raw[ends - 1].astype(np.int64)
    kind = np.where(upper[starts], 1, np.where(other[starts], 2 + first % 32, 0))
    tail = np.where(other[ends - 1], last, 0)
    caps = np.minimum(capitals[ends] - capitals[starts], 3)
    mark = np.minimum(marks[ends] - marks[starts], 4)
    size = np.minimum(np.log2(length + 1).astype(np.int64), 6)
    hashes = word_hashes(raw, starts, ends)
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
    same[first_words[first_words < len(same)]] = False
    return ((((kind * 128 + tail) * 4 + caps) * 5 + mark) * 7 + size) * 2 + same


def indicators(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct n-grams of each row, as positions of a vector of KINDS * BINS."""
    starts, ends, of = word_bounds(raw, offsets)
    shape = _shapes(raw, starts, ends, of[:-1]).astype(np.uint64) if len(starts) else np.zeros(0, np.uint64)
    wide = raw.astype(np.uint64)
    mask = np.uint64(BINS - 1)
    threes = mix64(wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]) & mask if len(raw) > 2 else np.zeros(0, np.uint64)
    turn = np.uint64(0x9E3779B97F4A7C15)
    ones = mix64(shape + np.uint64(1)) & mask
    twos = mix64(shape[:-1] * turn + shape[1:] + np.uint64(2)) & mask if len(shape) > 1 else ones[:0]
    runs = mix64((shape[:-2] * turn + shape[1:-1]) * turn + shape[2:] + np.uint64(3)) & mask if len(shape) > 2 else ones[:0]
    kinds = [k.astype(np.int64) for k in (threes, ones, twos, runs)]
    flags = np.zeros(KINDS * BINS, bool)
    for a, b, c, d in zip(offsets[:-1], offsets[1:], of[:-1], of[1:], strict=True):
        spans = ((a, b - 2), (c, d), (c, d - 1), (c, d - 2))
        marked = [kinds[i][s:e] + i * BINS for i, (s, e) in enumerate(spans) if e > s]
        for m in marked:
            flags[m] = True
        found = np.flatnonzero(flags) if marked else np.zeros(0, np.int64)
        flags[found] = False
        yield found


def packed(found: np.ndarray) -> bytes:
    """Positions as bytes: four for each, or a bit for each that there may be, whichever is bounded."""
    if len(found) <= MOST_POSITIONS:
        return b"p" + found.astype(np.int32).tobytes()
    flags = np.zeros(KINDS * BINS, bool)
    flags[found] = True
    return b"b" + np.packbits(flags).tobytes()


def unpacked(held: bytes) -> np.ndarray:
    if held[:1] == b"p":
        return np.frombuffer(held, np.int32, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8, offset=1)))


class Rows:
    """Documents' indicators, kept packed; a document is unpacked when it is asked for."""

    def __init__(self, held: list[bytes]) -> None:
        self.held = held

    def __len__(self) -> int:
        return len(self.held)

    def __getitem__(self, i: int) -> np.ndarray:
        return unpacked(self.held[i])

    def part(self, wanted: np.ndarray) -> Rows:
        return Rows([h for h, w in zip(self.held, wanted, strict=True) if w])


class Values:
    """The values of Rows under log-count ratios, at unit length."""

    def __init__(self, rows: Rows, ratio: np.ndarray) -> None:
        self.rows, self.ratio = rows, ratio
        self.norms = [max(float(np.sqrt((ratio[r] ** 2).sum())), 1e-9) for r in rows]

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ratio[self.rows[i]] / self.norms[i]


@dataclass
class Model:
    """weight and ratio for each indicator; bias; and the scale that turns margins into scores."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        """The margin of a document with these indicators, each worth its log-count ratio, at unit length."""
        norm = float(np.sqrt(self.square[found].sum()))
        return (float(self.product[found].sum()) / norm if norm else 0.0) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))

    def __post_init__(self) -> None:
        self.square = self.ratio**2
        self.product = self.weight * self.ratio


def log_count_ratio(rows: Sequence[np.ndarray], good: np.ndarray) -> np.ndarray:
    """For each indicator the logarithm of its share among the good documents' indicators over that among the others', each counted once more."""
    counts = [np.full(KINDS * BINS, SMOOTHING) for _ in (0, 1)]
    for found, y in zip(rows, good, strict=True):
        counts[int(y)][found] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: Sequence[np.ndarray], values: Sequence[np.ndarray], signs: np.ndarray, costs: np.ndarray, width: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum of cost * hinge loss, one dual variable at a time.

    Each visit of an example solves its one-variable problem and clips it to
    [0, cost]; the bias is the weight of a constant 1.
    """
    rng = np.random.default_rng(SEED)
    w, bias, dual = np.zeros(width), 0.0, np.zeros(len(rows))
    size = np.array([float(v @ v) + 1 for v in values])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, value = rows[i], values[i]
            gradient = signs[i] * (float(w[at] @ value) + bias) - 1
            to = min(max(dual[i] - gradient / size[i], 0.0), costs[i])
            if (step := (to - dual[i]) * signs[i]) != 0.0:
                w[at] += step * value
                bias += step
                dual[i] = to
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, bias


def scale(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, with targets drawn in from 0 and 1."""
    n1, n0 = int(good.sum()), int((~good).sum())
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2) * 1e-3
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-3 * (beta - [1.0, 0.0]))
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: Rows, good: np.ndarray) -> Model:
    """The model of labelled documents; with labels of one kind only, every score is the share of good ones, drawn in."""
    part = np.arange(len(rows)) % SCALE_PART == 0
    if len(set(good[part])) < 2 or len(set(good[~part])) < 2:
        part = np.zeros(len(rows), bool)
    width = KINDS * BINS
    if len(set(good.tolist())) < 2:
        share = (good.sum() + 1) / (len(good) + 2)
        return Model(np.zeros(width), np.zeros(width), 0.0, 1.0, float(np.log(share / (1 - share))))
    learn = rows.part(~part)
    y = good[~part]
    ratio = log_count_ratio(learn, y)
    values = Values(learn, ratio)
    costs = COST * np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    weight, bias = dual_coordinate_descent(learn, values, np.where(y, 1.0, -1.0), costs, width)
    model = Model(ratio, weight, bias, 1.0, 0.0)
    held = rows.part(part) if part.any() else learn
    margins = np.array([model.margin(r) for r in held])
    model.slope, model.shift = scale(margins, good[part] if part.any() else y)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, raw, offsets in text_steps(batch.column("text")):
            found = [packed(f) for f in indicators(raw, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), batch.column("good").slice(first, end - first), pa.array(found, pa.binary())], names=["doc_id", "good", "found"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most sample labelled documents that aren't held out.

    Their indicators, not their texts, reach the driver: at most 16 kB each. A
    doc_id that is labelled more than once counts once, as bad if any label
    says so; of its listings in docs the least text stands for it.
    """
    known = labels.groupBy("doc_id").agg((F.min("quality") == 1).alias("good")).filter("doc_id is not null and good is not null").filter(~held_out(F.col("doc_id")))
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    rows = texts.select("doc_id", "good", "text").mapInArrow(_features, "doc_id long, good boolean, found binary")
    got = sorted(rows.collect(), key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64), r["doc_id"]))
    return fit(Rows([bytes(r["found"]) for r in got]), np.array([r["good"] for r in got], bool))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    Whole texts give the indicators. Null, empty and wordless texts have none:
    their score is that of the bias. A null doc_id isn't held out. Without
    labels of both kinds all scores are alike. Repeated rows get equal scores;
    other columns are ignored; no rows give no rows. A text is one task's work,
    in memory of some 40 times its size.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            found = [m.score(f) for _, _, raw, offsets in text_steps(batch.column("text")) for f in indicators(raw, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rated = docs.select("doc_id", "text").mapInArrow(rate, "doc_id long, score double")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
