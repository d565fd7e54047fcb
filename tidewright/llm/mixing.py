"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.textkit import WORD
from tidewright.storage import written

#: Weights of the sources in their order, repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its size.
MOST_REPEATS = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size and target for each source of sized(source, size).

    The sizes are summed with partial aggregation; what follows works on one
    row for each source. The rows are ranked by ranges of the source's name:
    positions within each range plus the number of rows of earlier ranges,
    so no task sees all sources. Targets are reshared until none is above
    most times its source: each round sends two sums to the driver, and the
    rounds end when a round caps no further source.
    """
    spark = sized.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = written(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()),
        "mix-sources",
    )
    counts = {r["part"]: r["count"] for r in sums.groupBy("part").count().collect()}
    before, at = {}, 0
    for part in sorted(counts):
        before[part], at = at, at + counts[part]
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    place = offset[F.col("part")] + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    ranked = sums.withColumn("place", place).select(
        "source", "source_size", F.array(*[F.lit(w) for w in weights])[(F.col("place") % len(weights)).cast("int")].cast("long").alias("weight")
    )
    above = F.lit(False)
    capped, rest, weight, total = -1, 0, 0, None
    while True:
        row = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.count_if(above).alias("capped"),
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)).alias("used"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if row["capped"] == capped:
            break
        capped, rest, weight = row["capped"], row["total"] - most * row["used"], row["weight"]
        share = F.col("weight") * (F.lit(float(rest)) / F.lit(float(weight))) if weight else F.lit(0.0)
        above = above | (share > F.col("source_size") * most)
    target = F.when(above, (F.col("source_size") * most).cast("double")).otherwise(share)
    return ranked.select("source", "source_size", target.alias("target"))


def unit_draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone; 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def repeats(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The columns of docs as c0, c1 and so on, with size, source_size, target and copies: floor(rate) and one more with the fraction's chance.

    rate is target / source_size, the same for all rows of a source; a source
    without words has rate 0. Null texts have size 0, null sources form one
    source that comes last. Reruns give the same draws: a draw depends on the
    doc_id alone, so rows that repeat a doc_id, and all rows without one, have
    the same draw in a source. A text of any length is one row whose words are
    counted in place. Empty docs give no rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text, source = (names[docs.columns.index(n)] for n in ("doc_id", "text", "source"))
    plain = docs.toDF(*names)
    sized = plain.withColumn("size", n_words(F.col(text)))
    targets = source_targets(plain.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        sized.join(targets, sized[source].eqNullSafe(targets["source"]))
        .drop("source")
        .withColumn("copies", (F.floor(rate) + F.when(unit_draw(F.col(doc_id), seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long"))
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (the document's words in the mix, repeats counted), one row for each of docs."""
    return repeats(docs.select("doc_id", "text", "source")).select(F.col("c0").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as its copies say, with the columns of docs, whatever their names."""
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth")
    taken = repeats(docs).filter("copies > 0").select("*", each)
    return taken.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


ORACLE = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM src),
by_cap AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         coalesce(sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_w
  FROM ranked),
level AS (
  SELECT (total - 3 * used)::DOUBLE / (weights - used_w)::DOUBLE AS unit FROM by_cap
  WHERE weight * ((total - 3 * used)::DOUBLE / (weights - used_w)::DOUBLE) <= 3 * source_size
  ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN weight * unit > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE weight * unit END AS target
  FROM ranked, level),
rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM rated
"""
