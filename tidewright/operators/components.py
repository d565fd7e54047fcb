"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.storage import discarded, written


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hang the larger neighbours of each node on the smallest of its neighbourhood; also the table of minima that the plan reads."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    least = written(least, "least")
    return both.filter("v > u").join(least.hint("merge"), F.col("u") == F.col("k")).select(F.col("m").alias("u"), "v").filter("u <> v").distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hang each node and its smaller neighbours on the smallest of them; edges have u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("k"), "m")
    least = written(least, "least")
    up = edges.join(least.hint("merge"), F.col("v") == F.col("k"))
    return up.select(F.col("m").alias("u"), F.col("u").alias("v")).union(least.select(F.col("m").alias("u"), F.col("k").alias("v"))).filter("u <> v").distinct(), least


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(u, v), both of one type that has an order; root is the component's smallest node.

    Every round is a few joins and grouped minima of two-column rows, and is
    written to the shared folder, so lineage stays short and no links reach the
    driver: only a count and a checksum do, to see that nothing changed. What a
    round has read is deleted when it is done. Hot nodes are pre-aggregated for
    the minimum; the minima are written and merged by sorting, so that both
    sides of the join are plain shuffles, which AQE can split, and nothing that
    grows with the graph is broadcast.
    Self-links and repeated or turned links are allowed; no links give no rows.
    """
    now = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    now = written(now, "components")
    seen = None
    while (state := _state(now)) != seen:
        seen = state
        large, least = _large_star(now)
        hung = written(large, "components")
        discarded(now, least)
        small, least = _small_star(hung)
        now = written(small, "components")
        discarded(hung, least)
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
