"""Operator 6: byte-level BPE encoding and decoding.

Texts are pre-tokenised in whole batches by `scan.run_transducer` (code point classes, state maps, prefix scan; no
regular expression), the resulting byte slices go through pair merging with a bounded cache, and the slices'
offsets stay with the ids, so that decoding is exact.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import scan
from .batches import small_batches

CACHE = 250_000  # distinct pre-tokens kept by each Python worker
HEAP_FROM = 48  # symbols; longer pre-tokens merge with a heap, so that one huge run stays n log n
_models: dict[str, "Ranks"] = {}


class Ranks:
    """Token ids by bytes, which are merge ranks too, and the pairs that merge."""

    def __init__(self, rank_file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.token = {i: t for t, i in ranks.items()}
        self.pair = {
            (ranks[t[:k]], ranks[t[k:]]): i
            for t, i in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        }
        self.cache: dict[bytes, tuple] = {}

    def merge(self, piece: bytes) -> list[int]:
        ids = [self.single[b] for b in piece]
        if len(ids) > HEAP_FROM:
            return self._merge_heap(ids)
        get, none = self.pair.get, 1 << 60
        rank = [get(p, none) for p in zip(ids, ids[1:])]
        while rank and (best := min(rank)) != none:
            k = rank.index(best)
            ids[k] = best
            del ids[k + 1], rank[k]
            if k:
                rank[k - 1] = get((ids[k - 1], best), none)
            if k < len(rank):
                rank[k] = get((best, ids[k + 1]), none)
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.pair.get
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = r, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (x := get((r, ids[after[k]]))) is not None:
                    heapq.heappush(heap, (x, k, r, ids[after[k]]))
            if before[k] >= 0 and (x := get((ids[before[k]], r))) is not None:
                heapq.heappush(heap, (x, before[k], ids[before[k]], r))
        return [i for i in ids if i >= 0]

    def __call__(self, pieces: list[bytes]) -> list[tuple]:
        """(ids, their decimals joined by a space) of each pre-token."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        out = list(map(cache.get, pieces))
        if None in out:
            for k, x in enumerate(out):
                if x is None:
                    if (x := cache.get(pieces[k])) is None:
                        ids = self.merge(pieces[k])
                        x = cache[pieces[k]] = (tuple(ids), " ".join(map(str, ids)))
                    out[k] = x
        return out


def ranks_of(rank_file: bytes) -> Ranks:
    key = hashlib.md5(rank_file).hexdigest()
    if key not in _models:
        _models[key] = Ranks(rank_file)
    return _models[key]


def pretokens(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a batch, first and last byte offset of each pre-token, and pre-tokens before each text (one more)."""
    joined = scan.MARK.join(texts) + scan.MARK
    cps = scan.code_points(joined)
    starts = scan.run_transducer(scan.symbols_of(cps), *scan.pattern_tables(True, True)).view(bool)
    width = 1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000)
    at = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    marks = np.flatnonzero((cps >= 0xD800) & (cps < 0xE000))
    first = np.flatnonzero(starts)
    ends = np.sort(np.concatenate([first, marks]))
    last = ends[np.searchsorted(ends, first, side="right")]
    per_text = np.searchsorted(first, marks)
    return joined.encode("utf-8", "surrogatepass"), at[first], at[last], np.concatenate([[0], per_text])


def encode_batch(texts: list[str], model: Ranks) -> Iterator[tuple[bytes, list[bytes], list[tuple], np.ndarray]]:
    for a, b in scan.slabs(texts):
        data, first, last, per_text = pretokens(texts[a:b])
        pieces = [data[i:j] for i, j in zip(first.tolist(), last.tolist())]
        codes = model(pieces)
        for k in range(b - a):
            i, j = per_text[k], per_text[k + 1]
            yield codes[i:j], first[i:j] - (first[i] if j > i else 0)


def encode(df: DataFrame, rank_path: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Adds `token_ids` array<int> (and, with offsets, `pretoken_offsets`, the first byte of each pre-token).

    Null texts count as empty and give an empty array. The other columns stay; a column that is already called
    token_ids (pretoken_offsets) is replaced. One narrow pass: no shuffle, rows keep their partitions.
    """
    rank_file = _read(rank_path)
    extra = [pa.field("token_ids", pa.list_(pa.int32()))] + [pa.field("pretoken_offsets", pa.list_(pa.int64()))] * offsets
    keep = [c for c in df.columns if c not in {f.name for f in extra}]
    df = small_batches(df).select(*[F.col(f"`{c}`") for c in keep])
    added = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("pretoken_offsets", T.ArrayType(T.LongType()))]
    schema = T.StructType([*df.schema.fields, *added[: 1 + offsets]])

    def go(batches):
        model = ranks_of(rank_file)
        for batch in batches:
            texts = [x or "" for x in batch.column(keep.index(text_col)).to_pylist()]
            ids, at = [], []
            for codes, first in encode_batch(texts, model):
                ids.append([i for c in codes for i in c[0]])
                at.append(first.tolist())
            cols = [*batch.columns, pa.array(ids, extra[0].type)] + ([pa.array(at, extra[1].type)] if offsets else [])
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *[f.name for f in extra]])

    return df.mapInArrow(go, schema)


def decode(df: DataFrame, rank_path: str, ids_col: str = "token_ids") -> DataFrame:
    """Adds `decoded` binary: the bytes of the ids of each row, in order; null ids give empty bytes."""
    rank_file = _read(rank_path)
    keep = [c for c in df.columns if c != "decoded"]
    df = small_batches(df).select(*[F.col(f"`{c}`") for c in keep])

    def go(batches):
        token = ranks_of(rank_file).token
        for batch in batches:
            out = [b"".join([token[i] for i in x or ()]) for x in batch.column(keep.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return df.mapInArrow(go, T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digest(df: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every text, decodes the ids again, and returns id, n_tokens, ids_sha256 and decoded_sha256.

    with_ids: also token_ids. Null texts count as empty: no token, and the digests of the empty string. Repeated rows and
    null ids stay.
    """
    rank_file = _read(rank_path)
    df = small_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids]

    def go(batches):
        model = ranks_of(rank_file)
        token, sha = model.token.__getitem__, hashlib.sha256
        for batch in batches:
            texts, n, a, b, kept = [x or "" for x in batch.column(1).to_pylist()], [], [], [], []
            for codes, _ in encode_batch(texts, model):
                ids = [i for c in codes for i in c[0]]
                n.append(len(ids))
                a.append(sha(" ".join([c[1] for c in codes]).encode()).hexdigest())
                b.append(sha(b"".join(map(token, ids))).hexdigest())
                kept.append(np.array(ids, np.int32) if with_ids else None)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return df.mapInArrow(go, schema)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
