"""Operator 8: substring dedup of word windows with a count-min prefilter.

Pass 1: every bundle of texts sketches its distinct windows; the sketches are merged by hash range (shard) into saturated
count-min rows, which never underestimate, and every bundle learns which of its windows may be repeated. Pass 2: only those
windows are grouped exactly (smallest doc_id) and the bundles remove what they cover. What travels between passes are sorted
arrays of hashes and bit sets, a few bytes a window.

A window is named by 128 bits: two multilinear hashes (a random 64-bit factor for every place of a word, and of a window)
modulo 2^64. For any two different windows, however built, they agree with a probability below 2^-110.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bundles as B

WINDOW = 13
SHARD_WINDOWS = 4 << 20  # windows that one shard is planned for
CELLS_BITS = 24  # cells of each of the two rows of a shard's sketch
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_FACTORS = np.random.default_rng(41).integers(0, 1 << 63, (2, 4096), np.uint64) * np.uint64(2) + np.uint64(1)


def _factors(k: int, place: np.ndarray) -> np.ndarray:
    """Random odd factors of places; beyond the table they come from a counter."""
    out = _FACTORS[k][place & 4095]
    far = np.flatnonzero(place >= 4096)
    if len(far):
        out[far] = B.mix(place[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _FACTORS[k][0]) | np.uint64(1)
    return out


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, both: bool) -> list[np.ndarray]:
    """One or two hashes of each span of data; the spans stand in order and apart."""
    size = end - start
    if not len(size):
        return [np.zeros(0, np.uint64)] * (1 + both)
    before = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(before, size)
    value = data[np.repeat(start, size) + place].astype(np.uint64) + np.uint64(1)
    return [B.mix(np.add.reduceat(_factors(k, place) * value, before) + size.astype(np.uint64)) for k in range(1 + both)]


def run_hashes(words: np.ndarray, first: np.ndarray, width: int, k: int) -> np.ndarray:
    """Hash of the `width` words from each of `first`."""
    out = np.zeros(len(first), np.uint64)
    for j, factor in enumerate(_factors(k, np.arange(width) + 64)):
        out += words[first + j] * factor
    return B.mix(out)


class Windows:
    """Words and windows of a bundle's texts. h1, h2: hashes of each window; row: its text; at: its first word."""

    def __init__(self, texts: list[bytes], live: list[bool], width: int, second: bool):
        n_words, h1, h2, row, at, self.words = [], [], [], [], [], []
        before = 0
        for a, b in B.slabs(texts):
            data = np.frombuffer(b"\n".join(texts[a:b]) + b"\n", np.uint8)
            word = ~_WHITE[data]
            edge = np.diff(word.astype(np.int8), prepend=0)
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            ends = np.cumsum([len(x) + 1 for x in texts[a:b]])
            text = np.searchsorted(ends, start, side="right")
            n_words.append(np.bincount(text, minlength=b - a))
            first = np.flatnonzero(text[width - 1 :] == text[: len(text) - width + 1]) if len(text) >= width else np.zeros(0, np.int64)
            first = first[np.array(live[a:b], bool)[text[first]]]
            for k, (one, out) in enumerate(zip(word_hashes(data, start, end, second), (h1, h2))):
                out.append(run_hashes(one, first, width, k))
            row.append(text[first] + a)
            at.append(first + before)
            before += len(start)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.n_words = cat(n_words, np.int64)
        self.h1, self.row, self.at = cat(h1, np.uint64), cat(row, np.int64), cat(at, np.int64)
        self.h2 = cat(h2, np.uint64) if second else None


def _distinct(keys: np.ndarray, ids: np.ndarray):
    """Sorted distinct keys, where each key is among them, and the smallest and largest id of each."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    where = np.empty(len(k), np.int64)
    where[order] = np.cumsum(new) - 1
    low, high = (f.reduceat(ids[order], at) if len(at) else ids[:0] for f in (np.minimum, np.maximum))
    return k[at], where, low, high


def _place(h1: np.ndarray, shards: int) -> np.ndarray:
    """Shard in the high, remainder in the low 32 bits."""
    low = np.uint64(0xFFFFFFFF)
    return (((h1 >> np.uint64(32)) * np.uint64(shards)) & ~low) | (h1 & low)


def _split(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(keys >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))


def _cells(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A window's cell in either row of its shard's sketch."""
    shift = np.uint32(32 - bits)
    return v >> shift, (v * np.uint32(0x9E3779B1)) >> shift


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def repeated_windows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, keep_text: bool = False,
    cells_bits: int = CELLS_BITS,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the words that stay, joined by one space).

    Words are runs of bytes that are not ASCII white space. A word goes if a window of `width` words that covers it also
    starts in a document with a smaller id; windows are judged on the input. Null texts have no word. Rows without an id,
    and rows that share their id, remove nothing from each other. Texts shorter than a window stay whole.
    """
    texts, n, size = B.bundled(df, id_col, text_col)
    shards = size // (6 * SHARD_WINDOWS) + 1

    def windows(table, second):
        bundle, ids, data = B.in_order(table)
        w = Windows(data, [i is not None for i in ids], width, second)
        own = np.array([i or 0 for i in ids], np.int64)[w.row]
        keys, where, low, high = _distinct(_place(w.h1, shards), own)
        return bundle, ids, data, w, own, keys, where, low < high

    def sketch(table):
        bundle, *_, keys, _, several = windows(table, False)
        cut, v = _split(keys, shards), keys.astype(np.uint32)
        some = [k for k in range(shards) if cut[k] < cut[k + 1]]
        parts = [(cut[k], cut[k + 1]) for k in some]
        return _rows({
            "shard": (some, pa.int32()), "bundle": ([bundle] * len(some), pa.int32()),
            "v": ([B.pack(v[a:b]) for a, b in parts], pa.binary()), "several": ([B.bits(several[a:b]) for a, b in parts], pa.binary()),
        })

    def merge(table):
        seen, again = np.zeros((2, 1 << cells_bits), bool), np.zeros((2, 1 << cells_bits), bool)
        parts = [B.unpack(x.as_buffer(), np.uint32) for x in table.column("v")]
        for v, several in zip(parts, table.column("several")):
            several = B.unbits(several.as_buffer(), len(v))
            for row, c in enumerate(_cells(v, cells_bits)):
                again[row][c[several]] = True
                again[row][c[seen[row][c]]] = True
                seen[row][c] = True
        maybe = [B.bits(again[0][a] & again[1][b]) for a, b in (_cells(v, cells_bits) for v in parts)]
        return _rows({
            "bundle": (table.column("bundle").to_pylist(), pa.int32()), "shard": (table.column("shard").to_pylist(), pa.int32()),
            "kind": ([0] * len(parts), pa.int32()), "bits": (maybe, pa.binary()),
        })

    def candidates(w, own, keys, where, answers):
        """Distinct (h1, h2) of the windows that may be repeated: their order, shard cuts, smallest ids, and the windows."""
        maybe, cut = np.zeros(len(keys), bool), _split(keys, shards)
        for shard, bits in answers:
            maybe[cut[shard] : cut[shard + 1]] = B.unbits(bits, cut[shard + 1] - cut[shard])
        pick = np.flatnonzero(maybe[where])
        place, h2 = _place(w.h1[pick], shards), w.h2[pick]
        # the shard comes first in `place`, the rest of h1 and h2 tell windows apart
        order = np.lexsort((h2, w.h1[pick], place >> np.uint64(32)))
        h1, h2, ids, row = w.h1[pick][order], h2[order], own[pick][order], place[order]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        low = np.minimum.reduceat(ids, at) if len(at) else ids
        return h1[at], h2[at], low, _split(row[at], shards), pick[order], np.cumsum(new) - 1

    def of_kind(table, kind):
        t = table.filter(pa.compute.equal(table.column("kind"), kind)) if table.num_rows else table
        return [(s.as_py(), b.as_buffer()) for s, b in zip(t.column("shard"), t.column("bits"))]

    def exact_parts(left, right):
        if not left.num_rows:
            return _rows({"shard": ([], pa.int32()), "bundle": ([], pa.int32()), "h1": ([], pa.binary()), "h2": ([], pa.binary()), "low": ([], pa.binary())})
        bundle, _, _, w, own, keys, where, _ = windows(left, True)
        h1, h2, low, cut, *_ = candidates(w, own, keys, where, of_kind(right, 0))
        some = [k for k in range(shards) if cut[k] < cut[k + 1]]
        part = lambda x: ([B.pack(x[cut[k] : cut[k + 1]]) for k in some], pa.binary())
        return _rows({"shard": (some, pa.int32()), "bundle": ([bundle] * len(some), pa.int32()), "h1": part(h1), "h2": part(h2), "low": part(low)})

    def group(table):
        col = lambda c, t: [B.unpack(x.as_buffer(), t) for x in table.column(c)]
        h1, h2, low = col("h1", np.uint64), col("h2", np.uint64), col("low", np.int64)
        sizes = np.cumsum([0, *map(len, h1)])
        h1, h2, low = map(np.concatenate, (h1, h2, low))
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        least = np.repeat(np.minimum.reduceat(low[order], at), np.diff(np.append(at, len(a))))
        earlier = np.empty(len(a), bool)
        earlier[order] = least < low[order]
        return _rows({
            "bundle": (table.column("bundle").to_pylist(), pa.int32()), "shard": (table.column("shard").to_pylist(), pa.int32()),
            "kind": ([1] * table.num_rows, pa.int32()), "bits": ([B.bits(earlier[i:j]) for i, j in zip(sizes, sizes[1:])], pa.binary()),
        })

    def remove(left, right):
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text]
        if not left.num_rows:
            return _rows(dict(zip(names, [([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())])))
        _, ids, data, w, own, keys, where, _ = windows(left, True)
        _, _, low, cut, pick, which = candidates(w, own, keys, where, of_kind(right, 0))
        earlier = np.zeros(len(low), bool)
        for shard, bits in of_kind(right, 1):
            earlier[cut[shard] : cut[shard + 1]] = B.unbits(bits, cut[shard + 1] - cut[shard])
        hit = w.at[pick[earlier[which] | (low[which] < own[pick])]]
        begin = np.concatenate([[0], np.cumsum(w.n_words)])
        cover = np.zeros(begin[-1] + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + width, -1)
        gone = np.cumsum(cover)[:-1] > 0
        kept = []
        for k, x in enumerate(data):
            own_gone = gone[begin[k] : begin[k + 1]]
            words = x.split()
            kept.append(b" ".join([y for y, g in zip(words, own_gone.tolist()) if not g] if own_gone.any() else words))
        out = [
            (ids, pa.int64()), (w.n_words, pa.int64()), (np.add.reduceat(np.append(gone, False), begin[:-1], dtype=np.int64) * (w.n_words > 0), pa.int64()),
            ([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), ([x.decode() for x in kept] if keep_text else [], pa.string()),
        ]
        return _rows(dict(zip(names, out)))

    answer = "bundle int, shard int, kind int, bits binary"
    maybe = texts.groupBy("bundle").applyInArrow(sketch, "shard int, bundle int, v binary, several binary").groupBy("shard").applyInArrow(merge, answer)
    by_bundle = texts.groupBy("bundle")
    found = by_bundle.cogroup(maybe.groupBy("bundle")).applyInArrow(exact_parts, "shard int, bundle int, h1 binary, h2 binary, low binary")
    earlier = found.groupBy("shard").applyInArrow(group, answer)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return by_bundle.cogroup(maybe.unionByName(earlier).groupBy("bundle")).applyInArrow(remove, out)
