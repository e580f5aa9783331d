"""Embedding columns as integer vectors in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """The vector is there, and so is each of its entries, as a finite number; an empty vector will not do."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def scaled(vector: Column, factor: int, offset: int = 0) -> Column:
    """``floor(factor * c) + offset`` of every entry ``c``, taken as a double."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * float(factor)).cast("long") + F.lit(offset).cast("long"))


def within(vector: Column, factor: int, bound: float) -> Column:
    """Every scaled entry is under ``bound`` in size, so that sums of products of them are exact in 64 bits."""
    return ~F.exists(vector, lambda c: F.abs(c.cast("double") * float(factor)) >= bound)


def usual_length(vectors: DataFrame, column: str) -> int:
    """The most frequent length (of equally frequent ones the largest); 0 for an empty table."""
    found = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def matrix(column: pa.Array, dtype: type = np.int64) -> np.ndarray:
    """Rows of a list column of one length, without nulls, as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def list_array(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(rows).reshape(-1)))
