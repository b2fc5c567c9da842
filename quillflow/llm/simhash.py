"""Operator 1: SimHash near-duplicates with bit-sliced comparison.

Fingerprints within `radius` bits of each other agree wholly on some of their bit blocks, so equal blocks bring the
candidates of every link together. Within such a bucket the fingerprints stand as bit planes: word w of plane b holds bit
b of 64 fingerprints. A probe meets 64 of them at a time: differing bits are added up by a carry-save counter, three
words of planes at once, and a block is abandoned as soon as all its counters exceed the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .batches import small_batches
from .components import components
from .stored import stored

SEED = 42
#: Larger buckets are compared as pairs of chunks of this many fingerprints, each pair a unit of work of its own.
CHUNK = 8192


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each of the text's word shingles; A-Z count as lower case. Fewer than `words` words are one shingle."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    data = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(words, len(tokens))
    digest, seed = xxhash.xxh64_intdigest, SEED
    spans = zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.array([digest(data[a:b], seed) for a, b in spans], np.uint64)


def fingerprint(text: str, words: int) -> int:
    """Bits set in over half the XXH64 hashes of the text's word shingles; A-Z count as lower case. No word: 0."""
    hashes = shingle_hashes(text, words)
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    over = np.flatnonzero(2 * count > len(hashes))
    return sum(1 << int(b) for b in over)


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    df = small_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def go(batches):
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return df.mapInArrow(go, "doc_id long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of the bits that a bucket's fingerprints agree on: every choice of blocks - radius whole blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(whole[i] for i in pick) for pick in combinations(range(blocks), blocks - radius)]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 x words: bit planes of fingerprints, 64 to a word."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, probes: np.ndarray, words: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Lanes (as bits) of planes[:, words] within radius bits of each probe; only lanes set in `lanes` count."""
    live = np.arange(len(probes))
    counter = [np.zeros(len(probes), np.uint64) for _ in range(max(3, radius.bit_length()))]  # ones, twos, fours, ...
    over = ~lanes  # lanes past the radius
    out = np.zeros(len(probes), np.uint64)
    for b in range(0, 64, 4):
        p, w = probes[live], words[live]
        d = [planes[k][w] ^ (np.uint64(0) - ((p >> np.uint64(k)) & np.uint64(1))) for k in range(b, b + 4)]
        # carry-save: three words of weight 1 become one of weight 1 and one of weight 2
        one, two = counter[:2]
        u = one ^ d[0]
        c0, one = (one & d[0]) | (u & d[1]), u ^ d[1]
        u = one ^ d[2]
        c1, one = (one & d[2]) | (u & d[3]), u ^ d[3]
        u = two ^ c0
        carry, two = (two & c0) | (u & c1), u ^ c1
        value = [one, two]
        for weight in counter[2:]:
            value.append(weight ^ carry)
            carry = weight & carry
        more = np.zeros_like(one)  # counter > radius, by comparing its bits from the top
        same = ~np.uint64(0)
        for k in reversed(range(len(value))):
            if radius >> k & 1:
                same = same & value[k]
            else:
                more |= same & value[k]
                same = same & ~value[k]
        over |= carry | more
        keep = over != ~np.uint64(0)
        if not keep.all():  # abandon blocks whose lanes are all past the radius
            live, over = live[keep], over[keep]
            value = [v[keep] for v in value]
            if not len(live):
                return out
        counter = value
    out[live] = ~over
    return out


class Forest:
    """Union-find over array positions; unions come as arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if len(a):
                np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while True:
            up = self.root[r]
            if (up == r).all():
                self.root[x] = r
                return r
            r = up


def near_links(fps: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fps[i] and some of fps[first[i]:last[i]] within radius bits, thinned to a spanning forest.

    first[i] > i. Returns pairs of positions that connect the same fingerprints as all links do.
    """
    planes, forest = planes_of(fps), Forest(len(fps))
    live = np.flatnonzero(first < last)
    word = first[live] >> 6
    one = np.uint64(1)
    while len(live):
        lo = np.maximum(first[live] - (word << 6), 0)
        hi = np.minimum(last[live] - (word << 6), 64)
        lanes = (~np.uint64(0) << lo.astype(np.uint64)) & (~np.uint64(0) >> (64 - hi).astype(np.uint64))
        for at in range(0, len(live), 1 << 16):
            part = slice(at, at + (1 << 16))
            hit = within(planes, fps[live[part]], word[part], lanes[part], radius)
            some = np.flatnonzero(hit)
            if len(some):
                bits = (hit[some][:, None] >> np.arange(64, dtype=np.uint64)) & one
                r, lane = np.nonzero(bits)
                forest.join(live[part][some][r], (word[part][some][r] << 6) + lane)
        word += 1
        go_on = (word << 6) < last[live]
        live, word = live[go_on], word[go_on]
    root = forest.find(np.arange(len(fps)))
    child = np.flatnonzero(root != np.arange(len(fps)))
    return child, root[child]


_LINK = "kind int, a long, b long, bucket long, chunk int, chunks int"


def _bucket_links(radius: int, chunk: int):
    """Rows sorted by (t, key): links within each bucket; members of buckets beyond CHUNK are passed on in chunks."""

    def frame(kind, a, b, bucket, part, parts):
        n = len(a)
        fill = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, t), n), t and pa.from_numpy_dtype(t))
        cols = [fill(kind, np.int32), fill(a, np.int64), fill(b, np.int64), fill(bucket, np.int64), fill(part, np.int32), fill(parts, np.int32)]
        return pa.RecordBatch.from_arrays(cols, names=["kind", "a", "b", "bucket", "chunk", "chunks"])

    def settle(bucket, fp):
        """Whole buckets."""
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        size = np.diff(cut)
        big = np.repeat(size > chunk, size)
        last = np.repeat(cut[1:], size)
        first = np.arange(1, len(fp) + 1)
        last = np.where(big, first, last)
        a, b = near_links(fp.view(np.uint64), first, last, radius)
        yield frame(0, fp[a], fp[b], 0, 0, 0)
        for k in np.flatnonzero(size > chunk):
            own = fp[cut[k] : cut[k + 1]]
            yield frame(1, own, 0, bucket[cut[k]], np.arange(len(own)) // chunk, -(-len(own) // chunk))

    def go(batches):
        held_b, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            bucket = np.concatenate([held_b, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(fp) and bucket[0] != bucket[-1] and len(fp) > 20_000:
                open_ = int(np.searchsorted(bucket, bucket[-1]))
                yield from settle(bucket[:open_], fp[:open_])
                bucket, fp = bucket[open_:], fp[open_:]
            held_b, held_f = bucket, fp
        if len(held_f):
            yield from settle(held_b, held_f)

    return go


def _chunk_links(radius: int):
    """Rows sorted by (bucket, i, j, chunk): links between the two chunks of a pair, or within one where they are the same."""

    def settle(i, j, chunk, fp):
        split = int(np.searchsorted(chunk, j)) if i != j else 0
        at = np.arange(len(fp))
        first = np.maximum(at + 1, split)
        last = np.where((at < split) | (i == j), len(fp), first)
        a, b = near_links(fp.view(np.uint64), first, last, radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    def go(batches):
        key, held = None, []
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            same = np.ones(len(cols[0]), bool)
            for c in cols[:3]:
                same[1:] &= c[1:] == c[:-1]
            cut = np.flatnonzero(np.append(~same, True)) if len(same) else []
            for a, b in zip([0, *cut], [*cut]):
                if a == b:
                    continue
                k = tuple(int(c[a]) for c in cols[:3])
                if k != key and held:
                    yield settle(key[1], key[2], *map(np.concatenate, zip(*held)))
                    held = []
                key = k
                held.append((cols[3][a:b], cols[4][a:b]))
        if held:
            yield settle(key[1], key[2], *map(np.concatenate, zip(*held)))

    return go


def links(fps: DataFrame, n: int, radius: int, chunk: int = CHUNK) -> DataFrame:
    """fps: distinct fp long, about n of them. Returns a, b: enough links of at most radius bits to connect all that are."""
    spare = 2  # whole blocks that every bucket agrees on; more of them as the table grows, so that buckets stay small
    while spare < 5 and n > 1 << (64 * spare // (radius + spare) + 8):
        spare += 1
    masks = block_masks(radius + spare, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # a bucket is named by a hash of the mask's number and the masked bits; a chance agreement only adds comparisons
    names = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])
    spread = fps.select(F.explode(names).alias("bucket"), "fp")
    met = spread.repartition(F.col("bucket")).sortWithinPartitions("bucket", "fp")
    found = stored(met.mapInArrow(_bucket_links(radius, chunk), _LINK))
    hot = found.filter("kind = 1").withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    i, j = F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")
    pairs = hot.select("bucket", i, j, "chunk", F.col("a").alias("fp")).repartition("bucket", "i", "j")
    more = pairs.sortWithinPartitions("bucket", "i", "j", "chunk", "fp").mapInArrow(_chunk_links(radius), "a long, b long")
    return found.filter("kind = 0").select("a", "b").unionByName(more)


def _labelled(docs: DataFrame, radius: int, chunk: int, least: Column) -> DataFrame:
    """docs: fp. Returns fp, least (over the rows of the fingerprint) and root, a fingerprint that names the component."""
    # exact copies and equal fingerprints meet first: from here on a fingerprint is one row
    distinct = stored(docs.groupBy("fp").agg(least.alias("least")))
    labels = components(links(distinct.select("fp"), distinct.count(), radius, chunk))
    return distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links of <= radius bits).

    One row per input row. Null and empty texts, and texts of white space, have fingerprint 0 and link like any other.
    Fewer than `words` words are one shingle. Null ids do not count for component_id, which is null where a component has
    no other. Extra columns are not read.
    """
    if not 0 <= radius <= 6:
        raise ValueError("radius must be 0 to 6")
    docs = stored(fingerprints(df, id_col, text_col, words))
    rooted = _labelled(docs, radius, chunk, F.min("doc_id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return docs.join(of, "fp").select("doc_id", text.alias("fingerprint"), "component_id")
