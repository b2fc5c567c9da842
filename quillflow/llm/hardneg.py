"""Operator 12: hard negatives, by a full sort of every anchor's scores.

A stated query set, the anchors, meets all rows in blocks. First each anchor meets the rows of its own label and keeps its
best, the positives. Then it meets every row: a block's whole-number scores are sorted by score and id, a binary search
finds where the scores that a positive allows begin and end, and the first entries of another label in between are read.
Blocks only ever pass on the few rows that a rank of the whole table can need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .stored import stored
from .vectors import SCALE, sound

ANCHORS = 4096  # anchors of a unit of work
ROWS = 2048  # least rows of a unit of work; more as the table grows, SPREAD units at first, up to NUMBERS components
SPREAD = 64
NUMBERS = 1 << 22
FEW = 100_000  # labels and lengths that are broadcast at most
SLAB = 64  # anchors whose scores are held at a time


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: as doubles where every sum stays below 2^53, else in int64."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2.0**53:
        return (a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return a @ x.T


def bounds(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score with low * positive <= 100 * score <= high * positive, without overflow."""
    whole_, part = np.divmod(positive, 100)
    return low * whole_ - (-low * part) // 100, high * whole_ + (high * part) // 100


def _units(batches, keys: int):
    """Tables of the rows (sorted by their first columns) that share those `keys` columns."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            key = tuple(c[a] for c in cols)
            if held and key != now:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _split(unit: pa.Table):
    """Anchors' and rows' ids and vectors, and the unit as a table of anchors and one of rows."""
    of = lambda t: (t.column("id").to_numpy(), np.stack([np.frombuffer(x.as_buffer(), np.int32) for x in t.column("v")]).astype(np.int64))
    asks = unit.column("asks").to_numpy()
    anchors, rows = unit.filter(pa.array(asks)), unit.filter(pa.array(~asks))
    return (anchors, rows, *of(anchors), *of(rows)) if anchors.num_rows and rows.num_rows else None


def _best_same(k: int):
    """Of each unit's rows, all of the anchors' label, every anchor's first k others."""

    def go(batches):
        for unit in _units(batches, 4):
            if (both := _split(unit)) is None:
                continue
            *_, ai, av, xi, xv = both
            out = []
            for at in range(0, len(ai), SLAB):
                for anchor, own in zip(ai[at : at + SLAB].tolist(), scores(av[at : at + SLAB], xv)):
                    order = np.lexsort((xi, -own))[: k + 1]
                    order = order[xi[order] != anchor][:k]
                    out.append((np.full(len(order), anchor), xi[order], own[order]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor_id", "positive_id", "positive_score"])

    return go


def _first_others(k: int, low: int, high: int):
    """Of each unit's rows, for every anchor and positive, the first k of another label whose scores the positive allows."""

    def go(batches):
        for unit in _units(batches, 3):
            if (both := _split(unit)) is None:
                continue
            anchors, rows, ai, av, xi, xv = both
            labels = np.unique(np.concatenate([anchors.column("label").to_numpy(), rows.column("label").to_numpy()]), return_inverse=True)[1]
            theirs, own_label = labels[len(ai) :], labels[: len(ai)]
            positives, out = anchors.column("positives").to_pylist(), []
            for at in range(0, len(ai), SLAB):
                for i, own in enumerate(scores(av[at : at + SLAB], xv), at):
                    order = np.lexsort((xi, -own))
                    falling = -own[order]
                    others = np.flatnonzero(theirs[order] != own_label[i])
                    ids, values = (np.array([p[c] for p in positives[i]], np.int64) for c in ("positive_id", "positive_score"))
                    least, most = bounds(values, low, high)
                    begin = np.searchsorted(others, np.searchsorted(falling, -most, "left"))
                    end = np.searchsorted(others, np.searchsorted(falling, -least, "right"))
                    for p, a, b in zip(range(len(ids)), begin.tolist(), end.tolist()):
                        hit = order[others[a : min(b, a + k)]] if a < b else order[:0]
                        out.append((np.full(len(hit), ai[i]), np.full(len(hit), ids[p]), np.full(len(hit), values[p]), xi[hit], own[hit]))
            cols = [pa.array(np.concatenate(c)) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(cols, names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return go


def _dealt(rows: DataFrame, anchors: DataFrame, shared: list[str], block: int, task) -> DataFrame:
    """Rows and anchors that agree in the columns `shared`, met in units (shared, anchor block, row block)."""
    n = rows.groupBy(*shared).agg(F.count("*").alias("n_rows"))
    m = anchors.groupBy(*shared).agg(F.count("*").alias("n_anchors"))
    blocks = n.join(m, shared).select(*shared, F.ceil(F.col("n_rows") / block).cast("int").alias("x"), F.ceil(F.col("n_anchors") / ANCHORS).cast("int").alias("y"))
    blocks = stored(blocks)
    blocks = F.broadcast(blocks) if blocks.count() <= FEW else blocks
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = [c for c in ("id", "label", "v", "positives") if c in anchors.columns and c not in shared]
    keys = [*shared, "a", "b"]
    more = [F.col(c) if c in rows.columns else F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in cols]
    met = rows.join(blocks, shared).select(*shared, each("y").alias("a"), deal("x").alias("b"), F.lit(False).alias("asks"), *more)
    asking = anchors.join(blocks, shared).select(*shared, deal("y").alias("a"), each("x").alias("b"), F.lit(True).alias("asks"), *cols)
    units = met.unionByName(asking).select(*keys, "asks", *cols)
    return units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(*task)


def _ranked(found: DataFrame, of: list[str], score: str, id_: str, k: int) -> DataFrame:
    order = Window.partitionBy(*of).orderBy(F.desc(score), id_)
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, anchors: Column, label: Column, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Vectors count as whole numbers, floor(256 x). Of each row where `anchors` holds, the positives are the first other rows
    of its label by inner product (higher first, ties to the smaller id), the negatives of each the first k rows of another
    label with low * positive_score <= 100 * negative_score <= high * positive_score; a positive without any has no row.
    Rows with a null label or id, or a vector that is null, empty, or holds a null, non-finite or out-of-range component
    (beyond +-2^20 or so: scores must fit a long) take no part; vectors meet those of their own length. Rows that share an
    id are one row, the first by vector and label. Other columns are not read, and an empty table gives an empty result.
    """
    v = F.col(f"`{vector_col}`")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(anchors, F.lit(False)).alias("anchor"), label.cast("string").alias("label"), v.alias("v"))
    rows = rows.filter(sound(F.col("v")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    rows = rows.groupBy("id").agg(F.min(F.struct("v", "label", "anchor")).alias("x")).select("id", "x.anchor", "x.label", "x.v")

    def pack(batches):
        for batch in batches:
            size = [len(x) for x in batch.column(3)]
            flat = np.floor(batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int32)
            own = [x.tobytes() for x in np.split(flat, np.cumsum(size)[:-1])] if size else []
            cols = [pa.array(size, pa.int32()), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["id", "anchor", "label", "dim", "v"])

    rows = stored(rows.mapInArrow(pack, "id long, anchor boolean, label string, dim int, v binary"))
    n, dim = rows.agg(F.count("*"), F.max("dim")).first()
    block = max(min(max(n // SPREAD, ROWS), NUMBERS // (dim or 1)), 1)
    asked = rows.filter("anchor")
    same = (_best_same(positives), "anchor_id long, positive_id long, positive_score long")
    near = stored(_ranked(_dealt(rows, asked, ["dim", "label"], block, same), ["anchor_id"], "positive_score", "positive_id", positives))
    of = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = stored(asked.join(of, asked["id"] == of["anchor_id"]).select("id", "label", "dim", "v", "positives"))
    others = (_first_others(k, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    found = _ranked(_dealt(rows, asked, ["dim"], block, others), ["anchor_id", "positive_id"], "negative_score", "negative_id", k)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
