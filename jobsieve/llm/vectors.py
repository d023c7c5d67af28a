"""What the vector operators share: which vectors count, and matrices of Arrow list columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    bound = F.lit(float("inf"))
    each = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bound))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(each, F.lit(False))


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """A list column without nulls, whose lists are equally long, as one row per list."""
    if not len(column):
        return np.zeros((0, 0), kind)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(kind, copy=False)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.reshape(-1), kind))
