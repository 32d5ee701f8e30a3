"""Vectors out of Arrow batches, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    """``vector`` as an array of doubles, whatever its numeric element type."""
    return vector.cast("array<double>")


def vectors(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """Each row's vector as doubles; None for a null one and for one that holds a null or non-finite component."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    offsets, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    finite = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    for k, valid in enumerate(there):
        start, end = offsets[k], offsets[k + 1]
        yield values[start:end] if valid and finite[start] == finite[end] else None
