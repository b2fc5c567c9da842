"""Operator 11: MinHash near-duplicates by tensored banding.

A few collections of minhashes, m of `width` each, make m (m - 1) / 2 tables: a table's key is what a pair of collections
gives, so m x width minhashes do for what that many independent tables would need their own for. Two sets of similarity s
agree in a collection with probability s^width and meet as soon as two of the m agree; m is the least that lets all but
MISSED of the pairs of just the required similarity meet.

Texts with the same set of shingles are one node. Every node of a bucket is first compared with the bucket's least node by
their whole sets, which connects most of a group by links to few nodes. Where a bucket still holds several components, its
nodes meet there: pairs that links do not connect, that have not met in a table before, and whose minhashes leave the
similarity possible, are compared by their whole sets. No link is an estimate, and no bucket is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .batches import small_batches
from .bundles import mix
from .components import components
from .naming import NAME, named
from .neargroups import _sets, _unit_rows, _units
from .simhash import shingle_hashes
from .stored import stored

MISSED = 0.001
SPARE = 4.0  # standard deviations that the least agreement of minhashes leaves below the mean at the required similarity
CHUNK = 1 << 11  # larger buckets are cut, and their parts met pair by pair
SETS_CHUNK = 1 << 9  # the same where nodes come with their sets
SLAB = 1 << 16  # pairs whose minhashes are compared at a time
WIDE = 1 << 28  # rows beyond which collections are wider, so that buckets stay small
ODD = np.uint64(0x9E3779B97F4A7C15)


def layout(rows: int, percent: int) -> tuple[int, int]:
    """Collections, and minhashes of each."""
    width = 3 if rows < WIDE else 4
    q, m = (percent / 100) ** width, 2
    while (1 - q) ** m + m * q * (1 - q) ** (m - 1) > MISSED:
        m += 1
    return m, width


def least_agreement(hashes: int, percent: int) -> int:
    s = percent / 100
    return max(0, int(hashes * s - SPARE * np.sqrt(hashes * s * (1 - s))))


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """sets x hashes: the least values of each set's hashes under so many orders (upper halves; all ones for no shingle)."""
    factors = mix(np.arange(1, hashes + 1, dtype=np.uint64) * ODD) | np.uint64(1)
    out = np.full((len(sets), hashes), 0xFFFFFFFF, np.uint32)
    held, size = [], 0
    for k, own in enumerate(sets):
        if len(own):
            held.append(k)
            size += len(own)
        if held and (size >= 1 << 15 or k == len(sets) - 1):
            flat = np.concatenate([sets[i] for i in held])
            begin = np.cumsum([0, *(len(sets[i]) for i in held[:-1])])
            for f, factor in enumerate(factors):
                out[held, f] = np.minimum.reduceat(flat * factor, begin) >> np.uint64(32)
            held, size = [], 0
    return out


def collections(sig: np.ndarray, width: int) -> np.ndarray:
    """sets x collections: one number for the `width` minhashes of each."""
    own = sig.reshape(len(sig), -1, width).astype(np.uint64)
    out = np.zeros(own.shape[:2], np.uint64)
    for k in range(width):
        out = mix((out * ODD) ^ own[:, :, k] ^ (np.uint64(k + 1) << np.uint64(40)))
    return out


def tables(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i + 1, m)]


def _table_bits(m: int) -> int:
    return max(1, (len(tables(m)) - 1).bit_length())


def _nodes(df: DataFrame, id_col: str, text_col: str, words: int, m: int, width: int) -> DataFrame:
    """One row a row of df: doc_id, its name, node (a hash of its set), n (size of the set), sig (minhashes)."""
    names, text = named(df, id_col, text_col)
    id_ = F.col(f"`{id_col}`").cast("long")
    rows = df.select(id_.alias("doc_id"), *[c.alias(k) for k, c in names.items()], text.alias("text"))

    def go(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), words)) for x in batch.column(4)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 1) for s in sets], np.uint64).view(np.int64)
            sig = [s.tobytes() for s in signatures(sets, m * width)]
            cols = [pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *cols], names=["doc_id", *NAME, "node", "n", "sig"])

    return rows.mapInArrow(go, "doc_id long, __no_id boolean, __id long, __text long, node long, n long, sig binary")


def _spread(m: int, width: int):
    """A node's rows, one in each table: bucket (its last bits are the table's number), node."""
    bits = np.uint64(_table_bits(m))

    def go(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = collections(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1), width)
            for t, (i, j) in enumerate(tables(m)):
                bucket = mix(own[:, i] ^ mix(own[:, j] + ODD)) << bits | np.uint64(t)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), batch.column(0)], names=["bucket", "node"])

    return go


def open_pairs(bucket: np.ndarray, n: np.ndarray, label: np.ndarray, sig: np.ndarray, first: np.ndarray, last: np.ndarray, m: int, width: int, percent: int):
    """Positions i, j (first[i] <= j < last[i]) and agreeing minhashes of pairs with different labels that may be similar and
    whose bucket is the first that they share."""
    table = np.array([1 << i | 1 << j for i, j in tables(m)], np.int64)[bucket & ((1 << _table_bits(m)) - 1)]
    own, enough = collections(sig, width), least_agreement(m * width, percent)
    count = np.maximum(last - first, 0)
    ends, found = np.cumsum(count), []
    for lo in range(0, int(ends[-1]) if len(ends) else 0, SLAB):
        at = np.arange(lo, min(lo + SLAB, int(ends[-1])))
        i = np.searchsorted(ends, at, "right")
        j = first[i] + at - (ends[i] - count[i])
        ok = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        same = np.zeros(len(i), np.int64)
        for c in range(m):
            same |= (own[i, c] == own[j, c]).astype(np.int64) << c
        rest = same & (same - 1)
        ok = (same ^ (rest & (rest - 1))) == table[i]  # the two lowest bits
        i, j = i[ok], j[ok]
        agree = (sig[i] == sig[j]).sum(1)
        ok = agree >= enough
        found.append((i[ok], j[ok], agree[ok]))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 3


def _columns(rows: pa.Table):
    """Of rows (bucket, a, b, probe, node, n, label, sig, ...) sorted by (bucket, a, b, probe): columns, and what each meets."""
    bucket, a, b, probe, node, n, label = (rows.column(k).to_numpy() for k in range(7))
    sig = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint32).reshape(len(node), -1)
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    cut = np.flatnonzero(new)
    length = np.diff(np.append(cut, len(bucket)))
    start = np.repeat(cut, length)
    targets = np.repeat(np.add.reduceat((probe < 1).astype(np.int64), cut), length)
    # probe 0: meets those before it; 1: meets others' targets; -1: is only a target
    last = np.where(probe == 0, np.arange(len(bucket)), np.where(probe == 1, start + targets, start))
    return bucket, node, n, label, sig, start, last


def _meet(m: int, width: int, percent: int):
    """bucket, node of all that are in a pair worth comparing."""

    def go(batches):
        for rows in _unit_rows(batches, CHUNK):
            bucket, node, n, label, sig, first, last = _columns(rows)
            i, j, _ = open_pairs(bucket, n, label, sig, first, last, m, width, percent)
            k = np.unique(np.concatenate([i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[k]), pa.array(node[k])], names=["bucket", "node"])

    return go


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least `percent` hundredths of their union in common."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _meet_with_sets(m: int, width: int, percent: int):
    """Links (a, b) of each unit between nodes that none connects yet, by their sets (the last column)."""

    def go(batches):
        for rows in _unit_rows(batches, SETS_CHUNK):
            bucket, node, n, label, sig, first, last = _columns(rows)
            i, j, agree = open_pairs(bucket, n, label, sig, first, last, m, width, percent)
            part = np.unique(label, return_inverse=True)[1].tolist()
            up, a, b = list(range(len(part))), [], []

            def root(x):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            sets = rows.column(8).chunk(0) if rows.num_rows else None
            own = lambda k: np.frombuffer(sets[k].as_buffer(), np.uint64)
            order = np.argsort(-agree, kind="stable")  # the likeliest first: their links make most others needless
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                u, v = root(part[x]), root(part[y])
                if u != v and similar(own(x), own(y), percent):
                    up[max(u, v)] = min(u, v)
                    a.append(x), b.append(y)
            ends = np.sort(np.stack([node[a], node[b]]), axis=0) if a else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])

    return go


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets are similar."""

    def go(batches):
        for batch in batches:
            keep = [similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in both), percent) for both in zip(batch.column(2), batch.column(3))]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(go, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (smallest doc_id reachable over links) and kept, a row for each of df.

    Links are between texts whose sets of word shingles have at least `percent` hundredths of their union in common; A-Z count
    as lower case, fewer than `words` words are one shingle. Texts without a word, null ones among them, have an empty set,
    no link and their own id. Null ids do not count for component_id, which is null where a component has no other; kept
    means doc_id = component_id, so rows that share the least id all stay, as do those without an id in a component without
    one. Sets are of 64-bit hashes. Other columns are not read; an empty table gives an empty result.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    m, width = layout(df.count(), percent)
    docs = stored(_nodes(small_batches(df), id_col, text_col, words, m, width))
    once = [F.first(c).alias(c) for c in ("n", "sig")]
    nodes = docs.filter("n > 0").groupBy("node").agg(*once, F.min("doc_id").alias("least"), F.min(F.struct(*NAME)).alias("row"))
    nodes = stored(nodes)
    sets_of = lambda wanted: _sets(df, nodes.join(wanted, "node").select("node", "row"), id_col, text_col, words)
    # every node against the least of its buckets
    spread = nodes.select("node", "sig").mapInArrow(_spread(m, width), "bucket long, node long")
    hubs = spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("size")).filter("size > 1").select("bucket", "hub")
    met = stored(spread.join(hubs, "bucket"))
    pairs = stored(met.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    sets = stored(sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()))
    links = stored(_linked(pairs, sets, percent))
    labels = components(links).withColumnRenamed("node", "at")
    # what buckets of several components hold
    left = met.join(labels, F.col("node") == F.col("at"), "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = left.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    left = stored(left.join(mixed, "bucket"))
    unit, kind = ["bucket", "a", "b"], (m, width, percent)

    def dealt(rows: DataFrame, size: int) -> DataFrame:
        with_minhashes = rows.join(nodes.select("node", "n", "sig"), "node")
        return _units(with_minhashes, size).select(*unit, "probe", "node", "n", "label", "sig")

    together = lambda rows: rows.repartition(*unit).sortWithinPartitions(*unit, "probe", "node")
    near = stored(together(dealt(left, chunk)).mapInArrow(_meet(*kind), "bucket long, node long").distinct())
    if not near.isEmpty():
        again = stored(dealt(left.join(near, ["bucket", "node"], "left_semi"), min(chunk, SETS_CHUNK)))
        with_sets = again.join(stored(sets_of(again.select("node").distinct())), "node").select(*again.columns, "shingles")
        more = stored(together(with_sets).mapInArrow(_meet_with_sets(*kind), "a long, b long"))
        labels = components(links.unionByName(more)).withColumnRenamed("node", "at")
    rooted = nodes.join(labels, F.col("node") == F.col("at"), "left").select("node", "least", F.coalesce("label", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    some = docs.filter("n > 0").select("doc_id", "n", "node").join(of, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = docs.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return some.unionByName(none).withColumn("kept", kept)
