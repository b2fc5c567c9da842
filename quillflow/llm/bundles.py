"""Bundles: texts dealt to groups of bounded size, so that several passes over them can exchange compact arrays.

A bundle is named by a hash of the row's id and text and keeps a fixed inner order, so every pass (and every retry after
a lost executor) sees the same texts at the same places, whichever tasks held them before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BUNDLE_BYTES = 8 << 20


def bundled(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """(bundle, doc_id, text) dealt by bundle, the number of bundles, and the bytes of all texts.

    Rows without an id may all be copies of one text; they are dealt by their place in the table as well.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    id_ = F.col(f"`{id_col}`").cast("long")
    salt = F.when(id_.isNull(), F.monotonically_increasing_id())
    base = df.select(id_.alias("doc_id"), text.alias("text"), salt.alias("salt"))
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = size // BUNDLE_BYTES + 1
    bundle = F.pmod(F.xxhash64("doc_id", "text", "salt"), F.lit(n)).cast("int").alias("bundle")
    return base.select(bundle, "doc_id", "text").repartition(n, "bundle"), n, size


def in_order(table: pa.Table) -> tuple[int, list, list[bytes]]:
    """Bundle's number, ids and texts (UTF-8), sorted by id and text; rows that tie are the same."""
    ids, texts = table.column("doc_id").to_pylist(), [x.encode() for x in table.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
    return table.column("bundle")[0].as_py(), [ids[k] for k in order], [texts[k] for k in order]


def slabs(texts: list[bytes], most: int = 1 << 20):
    """Cuts a list into runs (from, to) of about `most` bytes, at least one text each."""
    at = size = 0
    for k, x in enumerate(texts):
        if size and size + len(x) > most:
            yield at, k
            at, size = k, 0
        size += len(x) + 1
    if at < len(texts):
        yield at, len(texts)


def pack(x: np.ndarray) -> bytes:
    """An array as planes of bytes: those of sorted or small numbers are nearly constant and compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").view(bool)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Polynomial hashes modulo 2^64 of all spans of an array, from prefix sums; `base` is odd, so it has an inverse.

    Some regular strings agree whatever the base, so these hashes may bring things together but not call them equal.
    """

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), None, None

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        if self.up is None or len(self.up) < n + 1:
            size = max(n + 1, 1 << 16)
            self.up, self.down = (np.full(size, b, np.uint64) for b in (self.base, self.inverse))
            for p in (self.up, self.down):
                p[0] = 1
                np.cumprod(p, out=p)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=total[1:])
        return (total[ends] - total[starts]) * self.down[starts]
