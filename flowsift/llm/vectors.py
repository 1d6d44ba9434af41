"""Vectors of a table, cleaned, and small numpy helpers for searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, vec (array of double) without null ids, null vectors or null or non-finite components.

    Rows that share an id are one vector: that which sorts last.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite).groupBy("vec_id").agg(F.max("vec").alias("vec"))


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    long = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(long) and (long == width).all():
        return flat.reshape(len(long), width)
    out = np.zeros((len(long), width))
    row = np.repeat(np.arange(len(long)), long)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(long) - long, long)
    out[row, at] = flat
    return out


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best of each query: highest scores, ties to smaller ids; sorted by query and rank."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches as tables of exactly ``rows`` rows, and a last one."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            full = n // rows * rows
            for k in range(0, full, rows):
                yield table.slice(k, rows)
            held, n = table.slice(full).combine_chunks().to_batches(), n - full
    if n:
        yield pa.Table.from_batches(held)
