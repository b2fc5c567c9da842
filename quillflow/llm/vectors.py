"""Vectors as whole numbers: floor(256 x) of every component, exact in 64 bits."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE = 256


def limit(dim: int) -> int:
    """Largest whole component whose squared distances and inner products over all `dim` components fit a long."""
    return min(isqrt((2**63 - 1) // (4 * max(dim, 1))), 2**31 - 1)


def sound(vector: Column) -> Column:
    """True for vectors that hold a component, none of them null, non-finite or too large for `limit`."""
    most = F.floor(F.sqrt(F.lit(2.0**61) / F.greatest(F.size(vector), F.lit(1))))
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE <= F.least(most, F.lit(2.0**31)) - 1))
    return F.coalesce((F.size(vector) > 0) & fits, F.lit(False))


def whole(column: pa.Array, dim: int) -> np.ndarray:
    """rows x dim whole numbers of a column of vectors, all of `dim` components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, dim)


def lengths(rows: DataFrame, vector: str) -> list[int]:
    """The different lengths of vectors, of which a table usually has one."""
    return sorted(n for (n,) in rows.select(F.size(vector)).distinct().collect())
