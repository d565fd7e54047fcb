"""Scenarios dealt over tasks, with whole ones handed to a function some thousands of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def dealt(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """rows with those of a scenario one after another, in order.

    The number of partitions is set, since what scenarios take is time of
    solving, not bytes: partitions that are put together by size would leave
    small tables to one task.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def _firsts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where scenarios begin; nulls are one value."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        codes = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def whole(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where each scenario begins) of dealt() rows: about most rows, more only where one scenario has more."""
    kept, n, enough = [], 0, most
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(kept)
        firsts = _firsts(table, keys)
        if len(firsts) > 1:
            yield table.slice(0, firsts[-1]), firsts[:-1]
            table = table.slice(firsts[-1])
        kept, n = table.to_batches(), table.num_rows
        enough = max(most, 2 * n)
    if n:
        table = pa.Table.from_batches(kept)
        yield table, _firsts(table, keys)
