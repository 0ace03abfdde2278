"""Vectors as whole numbers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Components become floor(SCALE * x).
SCALE = 256


def whole(column: str = "embedding") -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    x = F.col(column)
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    return x.isNotNull() & F.coalesce(F.forall(x, lambda v: F.coalesce(finite(v), F.lit(False))), F.lit(False))


def integers(column: pa.Array, width: int, most: int) -> np.ndarray:
    """floor(SCALE * x) of whole vectors, each filled up with zeros to width; components beyond most are an error."""
    lengths = np.diff(column.offsets.to_numpy())
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(raw * SCALE)
    if len(x) and np.abs(x).max() > most:
        raise ValueError(f"components of more than {most // SCALE} are too large for sums in 64 bits")
    if (lengths == width).all():
        return x.astype(np.int64).reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = x
    return out


def longest(rows: DataFrame, column: str = "embedding") -> tuple[int, int]:
    """(rows, the largest number of components)."""
    n, size = rows.agg(F.count("*"), F.max(F.size(column))).first()
    return n, size or 0
