"""Vectors in batches: reading, cleaning and exact small helpers of the operators that work on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is neither null nor empty and holds neither nulls nor non-finite entries."""
    odd = F.exists(column, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(~odd)


def widest(vectors: DataFrame, column: str) -> tuple[int, int]:
    """(rows, longest vector)."""
    found = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(column)), F.lit(0)).alias("dims")).first()
    return found["n"], found["dims"]


def matrix(column: pa.Array, dims: int, dtype=np.float64) -> np.ndarray:
    """A batch's vectors as rows; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), dtype=dtype)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def scaled(a: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest entry near 1: exact, and squares neither overflow nor vanish."""
    top = np.abs(a).max(axis=1, initial=0)
    return np.ldexp(a, -np.frexp(top)[1][:, None])


def lengths(a: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows, summed row by row, so that equal rows have equal lengths."""
    return np.sqrt((a * a).sum(axis=1))


def cosines(a: np.ndarray, b: np.ndarray, a_length: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    """Cosines of rows paired in order, summed row by row, so that equal pairs have equal cosines."""
    return (a * b).sum(axis=1) / (a_length * b_length)


def small(batches, rows: int):
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
