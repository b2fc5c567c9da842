"""Operator 1 for a stated similarity: SimHash brings near-duplicates together, their shingle sets decide.

Two texts of similarity (Jaccard) s have shingle sets at an angle whose cosine is 2s / (1 + s), and each bit of their SimHash
fingerprints differs with the probability angle / pi: 0.15 at s = 0.8. Texts with the same set of shingles are one node. A
node has a fingerprint of 192 bits and stands in one bucket of each table, named by a few sampled bits of it; there are as
many bits as keep buckets small and as many tables as let all but MISSED of the pairs of the least similarity meet. In a
bucket the first 64 bits are compared bit-sliced, abandoned early, and all 192 of what is left. Every pair that comes
through is compared by its whole sets unless links already connect it, so no link is a chance agreement: first the nearest
few of every node, which connect most groups; then, where a bucket still holds several, the sets themselves meet there.
"""

from __future__ import annotations

from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .batches import small_batches
from .bitmaps import might_be_in
from .bundles import mix
from .components import components
from .naming import NAME, first_rows, named
from .simhash import Forest, planes_of, shingle_hashes, within
from .stored import stored

WORDS64 = 3  # words of a fingerprint
BUCKET = 2048  # nodes that a bucket is planned for
CHUNK = 1 << 14  # larger buckets are cut, and their parts met pair by pair
SETS_CHUNK = 1 << 11  # the same where nodes come with their sets
NEAREST = 2  # candidates of a node in a bucket that are compared first
MISSED = 0.002
SPARE = 3.6  # standard deviations that the limits of differing bits leave above the mean at the least similarity
_FPS = [f"f{k}" for k in range(WORDS64)]


def limits(similarity: float) -> tuple[float, int, int]:
    """Share of bits that differ at the similarity, and the most that may of 64 and of all."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    most = [ceil(bits * share + SPARE * sqrt(bits * share * (1 - share))) for bits in (64, 64 * WORDS64)]
    return share, *most


def layout(nodes: int, similarity: float) -> tuple[int, int]:
    """Bits of a bucket's name, and tables."""
    bits = max(4, ceil(log2(max(nodes, 1) / BUCKET))) if nodes > BUCKET else 0
    meet = (1 - limits(similarity)[0]) ** bits
    return bits, 1 if not bits else ceil(log(MISSED) / log(1 - meet))


def wide_fingerprint(shingles: np.ndarray) -> list[int]:
    """Bits set in over half the hashes of the distinct shingles; a shingle's further words are mixed from its first."""
    out = []
    for k in range(WORDS64):
        count = np.zeros(64, np.int64)
        for at in range(0, len(shingles), 1 << 14):
            part = shingles[at : at + (1 << 14)]
            h = part if not k else mix(part ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64)))
            count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        word = sum(1 << int(b) for b in np.flatnonzero(2 * count > len(shingles)))
        out.append(word - (1 << 64) if word >> 63 else word)
    return out


def _nodes(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """node, n (shingles), fingerprint, row (the name of its first row)."""
    names, text = named(df, id_col, text_col)
    rows = df.select(*[c.alias(k) for k, c in names.items()], text.alias("text"))

    def go(batches):
        for batch in batches:
            node, n, fps = [], [], []
            for x in batch.column(3):
                own = np.unique(shingle_hashes(x.as_py(), words))
                node.append(xxhash.xxh64_intdigest(own.tobytes(), 1)), n.append(len(own)), fps.append(wide_fingerprint(own))
            cols = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int32())]
            cols += [pa.array([f[k] for f in fps], pa.int64()) for k in range(WORDS64)]
            yield pa.RecordBatch.from_arrays([*cols, *batch.columns[:3]], names=["node", "n", *_FPS, *NAME])

    schema = "node long, n int, " + "".join(f"{c} long, " for c in _FPS) + "__no_id boolean, __id long, __text long"
    once = [F.first(c).alias(c) for c in ("n", *_FPS)]
    return rows.mapInArrow(go, schema).groupBy("node").agg(*once, F.min(F.struct(*NAME)).alias("row"))


def _sampled(bits: int, tables: int) -> list[np.ndarray]:
    rng = np.random.default_rng(31)
    return [rng.choice(64 * WORDS64, bits, replace=False) for _ in range(tables)]


def bucket_names(fps: np.ndarray, sampled: list[np.ndarray]) -> np.ndarray:
    """tables x nodes: the sampled bits of fingerprints (words x nodes), behind the table's number."""
    flags = np.unpackbits(np.ascontiguousarray(fps.T).view(np.uint8), axis=1, bitorder="little")
    out = np.zeros((len(sampled), fps.shape[1]), np.int64)
    for t, own in enumerate(sampled):
        out[t] = t << 44
        for k, b in enumerate(own):
            out[t] |= flags[:, b].astype(np.int64) << k
    return out


def _spread(bits: int, tables: int):
    """A node's rows, one in each table: bucket, node, n, fingerprint."""
    sampled = _sampled(bits, tables)

    def go(batches):
        for batch in batches:
            fps = np.stack([batch.column(2 + k).to_numpy() for k in range(WORDS64)])
            for name in bucket_names(fps, sampled):
                yield pa.RecordBatch.from_arrays([pa.array(name), *batch.columns], names=["bucket", "node", "n", *_FPS])

    return go


def near_pairs(fps: np.ndarray, n: np.ndarray, label: np.ndarray, table: np.ndarray, names: np.ndarray, first: np.ndarray, last: np.ndarray, most: int, similarity: float):
    """Positions (i, j), first[i] <= j < last[i], of nodes with different labels that may be similar and share no bucket of a
    table before theirs: for each i the `most` with the fewest differing bits; the positions i that have more; and all that are in
    a pair. What a group has in common is nearest to all of it, so that links run to it and not along chains."""
    _, coarse, fine = limits(similarity)
    planes, one = planes_of(fps[0]), np.uint64(1)
    found, paired = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    held = [np.zeros(0, np.int64)] * 3  # i, j and differing bits of the best so far
    live = np.flatnonzero(first < last)
    word = first[live] >> 6
    while len(live):
        lo, hi = np.maximum(first[live] - (word << 6), 0), np.minimum(last[live] - (word << 6), 64)
        lanes = (~np.uint64(0) << lo.astype(np.uint64)) & (~np.uint64(0) >> (64 - hi).astype(np.uint64))
        new = [held]
        for at in range(0, len(live), 1 << 14):
            part = slice(at, at + (1 << 14))
            hit = within(planes, fps[0][live[part]], word[part], lanes[part], coarse)
            some = np.flatnonzero(hit)
            r, lane = np.nonzero((hit[some][:, None] >> np.arange(64, dtype=np.uint64)) & one)
            i, j = live[part][some][r], (word[part][some][r] << 6) + lane
            far = sum(np.bitwise_count(f[i] ^ f[j]).astype(np.int64) for f in fps)
            fits = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6
            ok = np.flatnonzero((far <= fine) & fits & (label[i] != label[j]))
            i, j, far = i[ok], j[ok], far[ok]
            met = np.zeros(len(i), bool)
            for t in range(len(names)):
                met |= (names[t][i] == names[t][j]) & (t < table[i])
            i, j, far = i[~met], j[~met], far[~met]
            found += np.bincount(i, minlength=len(n))
            paired[i] = paired[j] = True
            new.append(_least(i, j, far, most))
        held = _least(*map(np.concatenate, zip(*new)), most)
        word += 1
        go_on = (word << 6) < last[live]
        live, word = live[go_on], word[go_on]
    return held[0], held[1], found > most, paired


def _least(i: np.ndarray, j: np.ndarray, far: np.ndarray, most: int) -> list[np.ndarray]:
    """Of each i the `most` entries with the least far."""
    order = np.lexsort((j, far, i))
    i, j, far = i[order], j[order], far[order]
    run = np.flatnonzero(np.diff(i, prepend=-1))
    rank = np.arange(len(i)) - np.repeat(run, np.diff(np.append(run, len(i))))
    return [x[rank < most] for x in (i, j, far)]


def _unit_rows(batches, chunk: int):
    """Columns of batches, joined and cut where a new unit (bucket, a, b) begins; at least about `chunk` rows at a time."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size > chunk:
            rows = pa.Table.from_batches(held).combine_chunks()
            key = [rows.column(k).to_numpy() for k in range(3)]
            other = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in key]))
            if len(other):
                open_ = int(other[-1]) + 1
                yield rows.slice(0, open_)
                held, size = rows.slice(open_).to_batches(), rows.num_rows - open_
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _ranges(rows: pa.Table):
    """Of rows (bucket, a, b, probe, node, n, label, fingerprint, ...) sorted by (bucket, a, b, probe): their columns, the units'
    beginnings, and the positions that each one meets."""
    bucket, a, b, probe, node, n, label, *fps = (rows.column(k).to_numpy() for k in range(7 + WORDS64))
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    cut = np.flatnonzero(new)
    length = np.diff(np.append(cut, len(bucket)))
    start = np.repeat(cut, length)
    targets = np.repeat(np.add.reduceat((probe < 1).astype(np.int64), cut), length)
    # 0: meets those before it; 1: only meets others' targets; -1: is only a target
    last = np.where(probe == 0, np.arange(len(bucket)), np.where(probe == 1, start + targets, start))
    return bucket, node, n, label, np.stack(fps).view(np.uint64), cut, start, last


def _meet(bits: int, tables: int, similarity: float):
    """Pairs (kind 0: two nodes) of each unit, the NEAREST of each node; of buckets that have more, the nodes that are in any
    pair (kind 1: bucket, node)."""
    sampled = _sampled(bits, tables)

    def go(batches):
        for rows in _unit_rows(batches, CHUNK):
            bucket, node, n, label, fps, _, first, last = _ranges(rows)
            i, j, more, paired = near_pairs(fps, n, label, bucket >> 44, bucket_names(fps, sampled), first, last, NEAREST, similarity)
            again = paired & np.isin(bucket, bucket[more])
            kind = np.repeat(np.array([0, 1], np.int32), [len(i), again.sum()])
            cols = [kind, np.concatenate([np.minimum(node[i], node[j]), bucket[again]]), np.concatenate([np.maximum(node[i], node[j]), node[again]])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "a", "b"])

    return go


def _meet_with_sets(bits: int, tables: int, similarity: float):
    """Links (a, b) of each unit between nodes that none connects yet, by their sets (the last column)."""
    sampled = _sampled(bits, tables)

    def go(batches):
        for rows in _unit_rows(batches, SETS_CHUNK):
            bucket, node, n, label, fps, _, first, last = _ranges(rows)
            i, j, *_ = near_pairs(fps, n, label, bucket >> 44, bucket_names(fps, sampled), first, last, len(node), similarity)
            forest = Forest(len(node))
            _, same = np.unique(np.stack([np.unique(bucket, return_inverse=True)[1], np.unique(label, return_inverse=True)[1]]), axis=1, return_inverse=True)
            order = np.argsort(same.ravel(), kind="stable")
            group = same.ravel()[order]
            forest.join(order[1:][group[1:] == group[:-1]], order[:-1][group[1:] == group[:-1]])  # connected before
            sets, out = rows.column(7 + WORDS64).chunk(0) if rows.num_rows else None, []
            own = lambda k: np.frombuffer(sets[int(k)].as_buffer(), np.uint64)
            run = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i))
            for a, b in zip(run[:-1].tolist(), run[1:].tolist()):
                one, others = i[a], j[a:b]
                for at in range(0, len(others), 64):  # nearest first: a link makes most of the rest needless
                    few = others[at : at + 64]
                    few = few[forest.find(few) != forest.find(np.array([one]))[0]]
                    if not len(few):
                        continue
                    mine, theirs = own(one), [own(k) for k in few]
                    each = np.concatenate(theirs)
                    hit = mine[np.minimum(np.searchsorted(mine, each), len(mine) - 1)] == each
                    size = np.array([len(x) for x in theirs])
                    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
                    near = few[both >= similarity * (len(mine) + size - both) - 1e-6]
                    forest.join(np.full(len(near), one), near)
                    out += [(node[one], node[k]) for k in near]
            x = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x.min(1)), pa.array(x.max(1))], names=["a", "b"])

    return go


def _units(met: DataFrame, chunk: int) -> DataFrame:
    """met with a, b (the parts of its bucket that meet) and probe (see _meet). Buckets of one label are left out.

    A large bucket is cut into parts, and its nodes that do not have its commonest label meet all parts.
    """
    labels = met.groupBy("bucket", "label").count().groupBy("bucket").agg(F.sum("count").alias("n_all"), F.max(F.struct("count", "label")).alias("top"))
    labels = labels.filter("n_all > top.count").select("bucket", "n_all", F.col("top.label").alias("top"), (F.col("n_all") - F.col("top.count")).alias("n_other"))
    own = met.join(labels, "bucket")
    parts, probes = (F.ceil(F.col(c) / chunk).cast("int") for c in ("n_all", "n_other"))
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cols = [c for c in met.columns]
    small = own.filter(F.col("n_all") <= chunk).select(*cols, F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("probe"))
    large = own.filter(F.col("n_all") > chunk)
    targets = large.select(*cols, each(probes).alias("a"), deal(parts).alias("b"), F.lit(-1).alias("probe"))
    asking = large.filter("label <> top").select(*cols, deal(probes).alias("a"), each(parts).alias("b"), F.lit(1).alias("probe"))
    return small.unionByName(targets).unionByName(asking)


def _within_parts(met: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """First round: every bucket, large ones only part by part; and the large buckets."""
    large = met.groupBy("bucket").count().filter(F.col("count") > chunk).select("bucket", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
    return met.join(large, "bucket", "left").select(*met.columns, part.alias("a"), F.lit(0).alias("b"), F.lit(0).alias("probe")), large


def _sets(df: DataFrame, rows: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """rows: node, row. Returns node, shingles (sorted 64-bit hashes)."""
    names, text = named(df, id_col, text_col)
    rows = stored(rows.select("node", "row.*").withColumn("h", F.xxhash64(*NAME)))

    def go(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(x.as_py(), words)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "shingles"])

    maybe = might_be_in(rows, "h")
    texts = df.select(*[c.alias(k) for k, c in names.items()], text.alias("text")).filter(maybe(F.xxhash64(*NAME)))
    return texts.join(rows, NAME).select("node", "text").dropDuplicates(["node"]).mapInArrow(go, "node long, shingles binary")


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets are similar."""

    def go(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-6)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(go, "a long, b long")


def one_of_each(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, chunk: int = CHUNK
) -> DataFrame:
    """Rows of df, all columns, one of each group of texts connected by links of at least `similarity`.

    It is the row with the smallest id, nulls last, then with the smallest hash of its text; rows equal in both are one.
    A-Z count as lower case, fewer than `words` words are one shingle, and texts without a word, null ones among them, are
    one group. No bucket is capped: a node is first compared with those few whose fingerprints are nearest, and where it has
    more, with all that earlier links do not connect to it. An empty table gives an empty result.
    """
    nodes = stored(_nodes(small_batches(df), id_col, text_col, words))
    some = nodes.filter("n > 0").select("node", "n", *_FPS)
    bits, tables = layout(some.count(), similarity)
    kind = "bucket long, node long, n int, " + ", ".join(f"{c} long" for c in _FPS)
    met = stored(some.mapInArrow(_spread(bits, tables), kind))
    unit, columns = ["bucket", "a", "b"], ["probe", "node", "n", "label", *_FPS]
    sets_of = lambda wanted: _sets(df, nodes.join(wanted, "node").select("node", "row"), id_col, text_col, words)
    # the nearest of every node, pair by pair
    units, large = _within_parts(met.withColumn("label", F.col("node")), chunk)
    dealt = units.select(*unit, *columns).repartition(*unit).sortWithinPartitions(*unit, "probe", "n", "node")
    found = stored(dealt.mapInArrow(_meet(bits, tables, similarity), "kind int, a long, b long"))
    pairs = stored(found.filter("kind = 0").select("a", "b").distinct())
    sets = stored(sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()))
    links = stored(_linked(pairs, sets, similarity))
    labels = components(links).withColumnRenamed("node", "at")
    # what is left of buckets that hold more, with the sets
    again = found.filter("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("node")).join(large, "bucket", "left_anti")
    left = met.join(again, ["bucket", "node"], "left_semi").unionByName(met.join(large, "bucket", "left_semi"))
    left = left.join(labels, F.col("node") == F.col("at"), "left")
    units = stored(_units(left.withColumn("label", F.coalesce("label", "node")).drop("at"), min(chunk, SETS_CHUNK)).select(*unit, *columns))
    if not units.isEmpty():
        dealt = units.join(stored(sets_of(units.select("node").distinct())), "node").select(*unit, *columns, "shingles")
        dealt = dealt.repartition(*unit).sortWithinPartitions(*unit, "probe", "n", "node")
        more = stored(dealt.mapInArrow(_meet_with_sets(bits, tables, similarity), "a long, b long"))
        labels = components(links.unionByName(more)).withColumnRenamed("node", "at")
    rooted = nodes.join(labels, F.col("node") == F.col("at"), "left").select("row", F.coalesce("label", "node").alias("root"))
    return first_rows(df, rooted.groupBy("root").agg(F.min("row").alias("row")).select("row.*"), id_col, text_col)
