"""Exact dedup: 128-bit content hashes with a comparison of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.textkit import SPACE


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def group_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    Rows are grouped by the MD5 of the normalised text together with the text
    itself: the hash groups, the comparison of the grouping key's bytes keeps
    apart texts that only share a hash. Partial aggregation leaves one row for
    each text and task before the shuffle, so a group of copies of any size
    arrives as a few rows. Only the groups of two or more, as hashes, meet the
    rows again; AQE can split a hot hash in that join as it has no text in it.

    Null texts are empty texts. The smallest doc_id stays; a null doc_id counts
    as the largest. Rows that repeat one doc_id and text are the same document
    listed more than once: each is counted and all of them have kept = true if
    that id stays. A very long text is normalised and hashed whole, and is one
    row of the shuffle. Other columns of docs are ignored. No rows give no rows.
    """
    text = normalised(F.col("text"))
    hashed = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.unhex(F.md5("text")).alias("h"))
    groups = hashed.groupBy("h", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    copies = groups.filter("group_size > 1").select("h", F.sha2("text", 256).alias("sha"), "keep_id", "group_size")
    rows = hashed.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"))
    return (
        rows.join(copies, (rows.h == copies.h) & (rows.text_sha256 == copies.sha), "left")
        .select(
            "doc_id",
            F.when(F.col("sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            "text_sha256",
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each normalised text.

    The row with the smallest doc_id stays; a null doc_id counts as the largest,
    so a row without an id stays only if no row with an id has its text. Of
    rows that share text and doc_id, null or not, one stays: that of the least
    hash over all columns. Other texts of a doc_id or of rows without an id
    aren't touched. Rows are grouped by hash and text as in group_copies() and
    carried through, so nothing is looked up by doc_id; partial aggregation
    leaves one row for each text and task before the shuffle. A very long text
    is one row, whole.
    """
    text = normalised(F.col("text"))
    tie = F.xxhash64(*[F.coalesce(docs[c].cast("string"), F.lit("\0")) for c in docs.columns])
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), tie)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), order.alias("order"), text.alias("key"))
    keyed = rows.select("row", "order", "key", F.unhex(F.md5("key")).alias("h"))
    return keyed.groupBy("h", "key").agg(F.min_by("row", "order").alias("row")).select("row.*")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
