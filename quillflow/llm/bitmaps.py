"""A test of 64-bit hashes against a set, by a bitmap of fixed size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

BITS = 24


def bitmap(keys: DataFrame, h: str) -> np.ndarray:
    """The bits at the places that keys.h names, 2 MB whatever the input."""
    at = F.pmod(F.col(h), F.lit(1 << BITS)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for k, part in parts:
        bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(part, np.uint8)
    return bits


def looked_up(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & ((1 << BITS) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def might_be_in(keys: DataFrame, h: str):
    """A boolean column function that is true for every hash in keys.h and false for most others, so that these never reach
    a shuffle. Beyond 16 million keys it stops helping, and never hurts."""
    bits = bitmap(keys, h)

    @F.pandas_udf("boolean")
    def test(x):
        import pandas as pd

        return pd.Series(looked_up(bits, x.to_numpy()))

    return test
