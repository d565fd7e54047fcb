"""Hard-negative mining: exact inner-product searches that an orthogonal PCA rotation cuts short.

Vectors are rotated into the principal axes of all rows. The product with an
anchor is summed over the leading axes first; what the rest can add is at most
the product of the residual norms (Cauchy-Schwarz), plus slack for rounding. A
pair that can't reach what the anchor still looks for is discarded there, and
the others go on to the next axes. Survivors are verified by integer products
of the unrotated components, and only these decide.

Anchors are a stated query set. They are dealt into blocks of bounded size,
each of which is held against all rows, which stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.storage import discarded, written

SCALE = 256
LABELS = 10
SHIFTED = 7
ANCHOR_EVERY = 100
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these hundredths of its positive's.
LEAST, MOST = 30, 90

#: Anchors of one block: what is broadcast is at most twice so many vectors and their positives.
BLOCK = 2048
#: Rows of one step of a task, and rows that a task handles at most (one core's share, if that is less).
STEP = 1024
TASK_ROWS = 1 << 20
#: Components that are gathered at a time to verify pairs.
VERIFIED = 1 << 22
#: Shares of the squared lengths that the leading axes of each stage have at least.
STAGES = (0.5, 0.8)
#: Rounding of rotated products, as a share of the product of the norms; components of doubles are off by about 1e-16 each.
SLACK = 1e-9
#: Squared length, in floors, beyond which a row's scores might not be longs.
LONGEST = 2.0**61


def usable(embeddings: DataFrame) -> DataFrame:
    """(id, label, v, row) of the rows that take part, with labels of every SHIFTED-th id moved on and components as whole numbers.

    Rows with a null label or vector, a null or non-finite component, or a
    squared length over LONGEST don't. row tells rows apart where ids repeat.
    """
    scaled = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.filter("label is not null and embedding is not null").filter(sound).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), scaled.alias("v"))
    short = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x) <= LONGEST
    label = F.when(F.col("id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.filter(short).select("id", label.alias("label"), F.transform("v", lambda x: F.floor(x).cast("long")).alias("v"), F.monotonically_increasing_id().alias("row"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Whole-number vectors as rows of width columns; shorter ones end in zeros."""
    offsets = np.asarray(column.offsets)
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == width).all():
        return values[offsets[0] : offsets[-1]].reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    at = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = values[offsets[0] : offsets[-1]]
    return out


def principal_axes(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(axes as columns, their shares of the squared lengths), largest first; the moments of all rows are summed on executors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("v"), width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total))], names=["axis", "sums"])

    cells = rows.select("v").mapInArrow(moments, "axis long, sums array<double>").select("axis", F.posexplode("sums").alias("other", "x"))
    summed = cells.groupBy("axis", "other").agg(F.sum("x").alias("x")).toArrow()  # width times width numbers
    total = np.zeros((width, width))
    total[np.asarray(summed.column("axis")), np.asarray(summed.column("other"))] = np.asarray(summed.column("x"))
    share, axes = np.linalg.eigh(total / max(1.0, np.trace(total)))
    return axes[:, ::-1].copy(), np.clip(share[::-1], 0, None)


class Rotation:
    """The axes and, for each stage, up to which of them it sums."""

    def __init__(self, axes: np.ndarray, shares: np.ndarray) -> None:
        self.axes = axes
        grown = np.cumsum(shares) / max(float(shares.sum()), 1e-300)
        cuts = {int(np.searchsorted(grown, s)) + 1 for s in STAGES}
        self.cuts = [0, *sorted(c for c in cuts if c < len(axes))]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rotated, norms beyond each cut, norms) of whole-number vectors."""
        y = x.astype(float) @ self.axes
        squares = np.cumsum((y * y)[:, ::-1], 1)[:, ::-1]
        beyond = np.stack([np.sqrt(squares[:, c]) if c < y.shape[1] else np.zeros(len(y)) for c in self.cuts], 1)
        return y, beyond, np.linalg.norm(x.astype(float), axis=1)


class Block:
    """Anchors of one block, rotated, and the search of rows that can reach a score."""

    def __init__(self, rotation: Rotation, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
        self.rotation = rotation
        self.ids, self.labels, self.rows, self.x = ids, labels, rows, x
        self.y, self.beyond, self.norms = rotation(x)

    def part(self, at: np.ndarray) -> Block:
        """The block of some of its anchors."""
        out = object.__new__(Block)
        out.rotation = self.rotation
        for name in ("ids", "labels", "rows", "x", "y", "beyond", "norms"):
            setattr(out, name, getattr(self, name)[at])
        return out

    def reach(self, x: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, anchor, score) of allowed pairs whose score is at least the anchor's low and, if given, at most its high."""
        y, beyond, norms = self.rotation(x)
        slack = SLACK * norms[:, None] * self.norms[None, :] + 1
        cuts = self.rotation.cuts
        live = allowed & (norms[:, None] * self.norms[None, :] + slack >= low[None, :])
        partial = np.zeros(live.shape)
        for k in range(1, len(cuts)):
            if not live.any():
                break
            partial += y[:, cuts[k - 1] : cuts[k]] @ self.y[:, cuts[k - 1] : cuts[k]].T
            bound = beyond[:, k : k + 1] * self.beyond[:, k][None, :] + slack
            live &= partial + bound >= low[None, :]
            if high is not None:
                live &= partial - bound <= high[None, :]
        v, a = np.nonzero(live)
        if not len(v):
            return v, a, np.zeros(0, np.int64)
        scores = self.verified(x, v, a, float(norms.max() * self.norms.max()), len(v) * 8 > live.size)
        keep = scores >= low[a]
        if high is not None:
            keep &= scores <= high[a]
        return v[keep], a[keep], scores[keep]

    def verified(self, x: np.ndarray, v: np.ndarray, a: np.ndarray, most: float, dense: bool) -> np.ndarray:
        """Integer products of pairs; where most pairs are left and doubles hold every sum exactly, as one matrix product."""
        if dense and most < 2.0**52:
            return (x.astype(float) @ self.x.T.astype(float))[v, a].astype(np.int64)
        step = max(1, VERIFIED // x.shape[1])
        return np.concatenate([np.einsum("ij,ij->i", x[v[i : i + step]], self.x[a[i : i + step]]) for i in range(0, len(v), step)])


class Best:
    """For each of some groups the first rows by score, then id (nulls last), then row."""

    def __init__(self, groups: int, size: int) -> None:
        self.size = size
        self.group = np.zeros(0, np.int64)
        self.score, self.none, self.id, self.row = (np.zeros(0, t) for t in (np.int64, bool, np.int64, np.int64))
        self.worst = np.full(groups, -(2.0**63))

    def add(self, group, score, none, ids, row) -> None:
        if not len(group):
            return
        columns = [np.concatenate(pair) for pair in ((self.group, group), (self.score, score), (self.none, none), (self.id, ids), (self.row, row))]
        order = np.lexsort((columns[4], columns[3], columns[2], -columns[1], columns[0]))
        columns = [c[order] for c in columns]
        first = np.searchsorted(columns[0], columns[0])
        place = np.arange(len(first)) - first
        columns = [c[place < self.size] for c in columns]
        self.group, self.score, self.none, self.id, self.row = columns
        full = place == self.size - 1
        at = np.flatnonzero(full[place < self.size])
        self.worst[self.group[at]] = self.score[at]


def _task_steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(ids, whether null, labels, rows, vectors) of at most STEP rows at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, STEP):
            part = batch.slice(i, STEP)
            ids = part.column("id")
            yield np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(part.column("label")), np.asarray(part.column("row")), _matrix(part.column("v"), width)


def _block_of(table: pa.Table, rotation: Rotation, width: int) -> Block:
    columns = [np.asarray(table.column(c).combine_chunks()) for c in ("id", "label", "row")]
    v = table.column("v").combine_chunks()
    return Block(rotation, *columns, _matrix(v if isinstance(v, pa.Array) else v.chunk(0), width))


def _positives(rows: DataFrame, block: Block, width: int) -> DataFrame:
    """(a, place, id, score): the first POSITIVES other rows of each anchor's label."""
    sent = rows.sparkSession.sparkContext.broadcast(block)  # at most twice BLOCK vectors

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        best = Best(len(block.ids), POSITIVES)
        for ids, none, labels, numbers, x in _task_steps(batches, width):
            for label in np.unique(labels):
                anchors, mine = np.flatnonzero(block.labels == label), np.flatnonzero(labels == label)
                if not len(anchors):
                    continue
                part = block.part(anchors)
                other = numbers[mine][:, None] != block.rows[anchors][None, :]
                v, a, score = part.reach(x[mine], other, best.worst[anchors], None)
                best.add(anchors[a], score, none[mine][v], ids[mine][v], numbers[mine][v])
        yield _found(best)

    return _first(rows.mapInArrow(search, FOUND), "a", POSITIVES)


FOUND = "a long, id long, row long, score long"


def _found(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(best.group), pa.array(best.id, mask=best.none), pa.array(best.row), pa.array(best.score)], names=["a", "id", "row", "score"])


def _first(found: DataFrame, group: str, size: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)


def _negatives(rows: DataFrame, block: Block, positives: dict[str, np.ndarray], width: int) -> DataFrame:
    """(a, place, id, score): the first NEGATIVES rows of other labels for each positive, by its number a in positives (anchor, score)."""
    low, high = -(-LEAST * positives["score"] // 100), MOST * positives["score"] // 100
    owner = positives["anchor"]
    sent = rows.sparkSession.sparkContext.broadcast((block, owner, low, high))  # at most twice BLOCK vectors and POSITIVES times as many numbers

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, owner, low, high = sent.value
        n = len(block.ids)
        best = Best(len(owner), NEGATIVES)
        first = np.searchsorted(owner, np.arange(n + 1))
        top = np.full(n, -(2.0**63))
        np.maximum.at(top, owner, high.astype(float))
        for ids, none, labels, numbers, x in _task_steps(batches, width):
            floor = np.full(n, 2.0**63)
            np.minimum.at(floor, owner, np.maximum(low, best.worst))
            v, a, score = block.reach(x, labels[:, None] != block.labels[None, :], floor, top)
            many = first[a + 1] - first[a]
            at = np.repeat(np.arange(len(a)), many)
            group = first[a[at]] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            fits = (score[at] >= low[group]) & (score[at] <= high[group]) & (score[at] >= best.worst[group])
            at, group = at[fits], group[fits]
            best.add(group, score[at], none[v[at]], ids[v[at]], numbers[v[at]])
        yield _found(best)

    return _first(rows.mapInArrow(search, FOUND), "a", NEGATIVES)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over all rows of embeddings(vec_id, embedding, label).

    Which rows take part says usable(). Anchors are those whose id is divisible
    by ANCHOR_EVERY, and each searches all rows. Equal scores come by smaller
    id, null ids last; a row with a repeated id is an anchor, positive or
    negative of its own, and never its own positive. Vectors may differ in
    length, missing components are zero. A null id is no anchor. Other columns
    are ignored; no rows, or no anchors, give no rows.

    Rows are written once, dealt evenly. For each block of BLOCK anchors two
    jobs go over them where they are: only first rows of a task leave it. The
    driver holds one block and its positives.
    """
    spark = embeddings.sparkSession
    rows = written(usable(embeddings), "vectors")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.count_if(F.col("id") % ANCHOR_EVERY == 0).alias("anchors")).first()
    width = max(1, stats["width"])
    if not stats["anchors"]:
        return spark.createDataFrame([], RESULT)
    tasks = max(spark.sparkContext.defaultParallelism, -(-stats["n"] // TASK_ROWS))
    dealt = written(rows.repartition(min(tasks, max(1, -(-stats["n"] // STEP)))), "vectors")
    blocks = -(-stats["anchors"] // BLOCK)
    anchors = written(rows.filter(F.col("id") % ANCHOR_EVERY == 0).repartition(blocks).withColumn("block", F.spark_partition_id()), "anchors")
    discarded(rows)
    rotation = Rotation(*principal_axes(dealt, width))
    out: DataFrame | None = None
    for k in range(blocks):
        held = anchors.filter(F.col("block") == k).drop("block").toArrow()
        if not held.num_rows:
            continue
        block = _block_of(held, rotation, width)
        pairs = _positives(dealt, block, width).select("a", "place", "id", "score").toArrow().sort_by([("a", "ascending"), ("place", "ascending")])
        if not pairs.num_rows:
            continue
        of = pa.table({"p": pa.array(np.arange(pairs.num_rows)), "anchor_id": pa.array(block.ids[np.asarray(pairs.column("a"))]), "positive_id": pairs.column("id"), "positive_score": pairs.column("score")})
        found = _negatives(dealt, block, {"anchor": np.asarray(pairs.column("a")), "score": np.asarray(pairs.column("score"))}, width)
        named = found.join(F.broadcast(spark.createDataFrame(of)), F.col("a") == F.col("p")).select(  # POSITIVES rows for each anchor of the block
            "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        named = written(named, "negatives")
        out = named if out is None else out.unionByName(named)
    discarded(anchors, dealt)
    return out if out is not None else spark.createDataFrame([], RESULT)


ORACLE = f"""
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS anchor_id, r.id, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM r AS a JOIN r ON r.id <> a.id WHERE a.id % {ANCHOR_EVERY} = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LEAST} * positive_score <= 100 * s.score AND 100 * s.score <= {MOST} * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= {NEGATIVES}
"""
