"""Operator 7: toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of the byte n-grams of its lower-cased words, word ends included. Every n-gram bucket has a small
vector; their mean goes through a linear softmax of two classes. Vectors and softmax are trained jointly in numpy (mini
batches, Adagrad), so a misspelt word is scored by the n-grams it shares. After training a bucket's vector and the
softmax collapse to one number per bucket, so scoring is a gather and a mean, vectorised over batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import scan
from .batches import small_batches

BITS = 20
GRAMS = (4, 5, 6)
DIM = 4
#: Training reads at most this many labelled rows of classes 0 and 1, the first by a seeded hash of their ids.
SAMPLE = (4000, 2000)
SAMPLE_BYTES = 64 << 20  # and of these, in the same order, at most so many bytes of whole texts, two thirds of class 0; a text that does not fit is left out alone
EPOCHS, UPDATES = 12, 400  # passes over the sample, more of them until there were this many updates
BATCH = 64
ONE_CLASS = 4.0  # bias where the sample has one class, or none: what is not shown to be toxic counts as clean
CONTRAST = 4.0  # least z between the classes of a bucket that is trained: less is chance among a million of them; other vectors stay zero
GAIN = 80.0  # scale of the mean: toxic words are a percent or two of a text
_WORD = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id is not held out (and has no label)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def gram_buckets(data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: positions and buckets of the n-grams of a byte array in which everything but words is a space.

    An n-gram lies within one word or one word and the space at either end.
    """
    word = data != 32
    out = []
    x = data.astype(np.uint32)
    run = word.copy()  # bytes i .. i+k are of a word
    h = x.copy()
    for n in range(2, max(GRAMS) + 1):
        # h: hash of bytes i .. i+n-2
        m = len(data) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(16777619) + x[n - 1 :]
        if n > 2:
            run = run[: m + 1] & word[n - 3 : n - 2 + m]
        inner = run[1 : m + 1]
        if n in GRAMS:
            at = np.flatnonzero(inner)
            v = h[at]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            v ^= v >> np.uint32(12)
            v *= np.uint32(0x297A2D39)
            v ^= v >> np.uint32(15)
            out.append((at, (v >> np.uint32(32 - BITS)).astype(np.int32)))
    return out


def bytes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lower-cased texts with everything but words as spaces, two spaces between texts, and the texts' ends."""
    parts = [x.lower().encode("utf-8", "replace") for x in texts]
    data = np.frombuffer(b" " + b"  ".join(parts) + b"  ", np.uint8)
    ends = np.cumsum([len(p) + 2 for p in parts])
    return np.where(_WORD[data], data, np.uint8(32)), ends


def bags(texts: list[str], wanted: np.ndarray | None = None):
    """Slab by slab: (text's index, bucket, occurrences) and n-grams of each text; `wanted` flags the buckets to return."""
    for a, b in scan.slabs(texts, 500_000):
        data, ends = bytes_of(texts[a:b])
        grams = gram_buckets(data)
        text = np.concatenate([np.searchsorted(ends, at, side="right") for at, _ in grams] or [np.zeros(0, np.int64)])
        total = np.bincount(text, minlength=b - a)[: b - a]
        bucket = np.concatenate([g for _, g in grams] or [np.zeros(0, np.int32)])
        if wanted is not None:
            text, bucket = text[wanted[bucket]], bucket[wanted[bucket]]
        key, n = np.unique(text.astype(np.int64) << BITS | bucket, return_counts=True)
        yield (key >> BITS).astype(np.int32) + a, (key & ((1 << BITS) - 1)).astype(np.int32), n.astype(np.float32), total


def _contrast(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """z of the difference between the shares of the classes' texts that have each bucket."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    has = np.zeros((2, 1 << BITS))
    for text, bucket, *_ in bags(texts):
        for y in (0, 1):
            has[y] += np.bincount(bucket[labels[text] == y], minlength=1 << BITS)
    p = has.sum(axis=0) / len(labels)
    return (has[1] / n1 - has[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))


def train(texts: list[str], labels: np.ndarray, seed: int = 11) -> np.ndarray:
    """Weights: one number per bucket and, last, the bias. Same rows in the same order give the same weights."""
    weights = np.zeros((1 << BITS) + 1, np.float32)
    if not len(texts) or labels.min() == labels.max():
        weights[-1] = ONE_CLASS if len(texts) and labels.min() else -ONE_CLASS
        return weights
    rng = np.random.default_rng(seed)
    # buckets that the classes hold about equally often would only be learnt by heart
    found = list(zip(*bags(texts, np.abs(_contrast(texts, labels)) >= CONTRAST)))
    text, bucket, n, total = map(np.concatenate, found)
    n /= np.maximum(total, 1)[text]
    start = np.searchsorted(text, np.arange(len(texts) + 1))
    vectors = np.zeros((1 << BITS, DIM), np.float32)
    used = np.unique(bucket)
    vectors[used] = rng.uniform(-1 / DIM, 1 / DIM, (len(used), DIM))
    square = np.full(1 << BITS, 1e-6, np.float32)
    soft, soft_square = rng.uniform(-1 / DIM, 1 / DIM, (DIM, 2)).astype(np.float32), np.full((DIM, 2), 1e-6, np.float32)
    bias, bias_square = np.log([1 - labels.mean(), labels.mean()]).astype(np.float32), np.full(2, 1e-6, np.float32)
    for _ in range(max(EPOCHS, UPDATES // -(-len(texts) // BATCH))):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            own = np.sort(order[k : k + BATCH])
            at = np.concatenate([np.arange(start[i], start[i + 1]) for i in own])
            if not len(at):
                continue
            row = np.repeat(np.arange(len(own)), start[own + 1] - start[own])
            b, w = bucket[at], n[at] * GAIN
            seen, where = np.unique(b, return_inverse=True)
            part = vectors[b] * w[:, None]
            mean = np.stack([np.bincount(row, part[:, d], len(own)) for d in range(DIM)], 1).astype(np.float32)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            p /= len(own)
            back = (p @ soft.T).astype(np.float32)
            grad = np.stack([np.bincount(where, back[row, d] * w, len(seen)) for d in range(DIM)], 1).astype(np.float32)
            square[seen] += (grad**2).mean(1)
            vectors[seen] -= 0.1 * grad / np.sqrt(square[seen])[:, None]
            g = mean.T @ p
            soft_square += g**2
            soft -= 0.1 * g / np.sqrt(soft_square)
            g = p.sum(0)
            bias_square += g**2
            bias -= 0.1 * g / np.sqrt(bias_square)
    weights[:-1] = vectors @ (soft[:, 1] - soft[:, 0]) * GAIN
    weights[-1] = bias[1] - bias[0]
    return weights


def score(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each whole text; a text without an n-gram gets the bias alone."""
    out = np.zeros(len(texts))
    for a, b in scan.slabs(texts, 500_000):
        data, ends = bytes_of(texts[a:b])
        total, n = np.zeros(b - a), np.zeros(b - a)
        for at, bucket in gram_buckets(data):
            cut = np.searchsorted(at, np.concatenate([[0], ends]))
            run = np.concatenate([[0.0], np.cumsum(weights[bucket], dtype=np.float64)])
            total += np.diff(run[cut])
            n += np.diff(cut)
        out[a:b] = total / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(out + weights[-1], -60, 60)))


def _that_fit(batches):
    """Rows (id, y, size) in order, less those whose text does not fit what its class has left of its share of SAMPLE_BYTES."""
    left = [SAMPLE_BYTES * SAMPLE[y] // (SAMPLE[0] + SAMPLE[1]) for y in (0, 1)]
    for batch in batches:
        keep = []
        for y, size in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            keep.append(size <= left[y])
            left[y] -= size * keep[-1]
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["id", "y"])


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> np.ndarray:
    """Trains in one task on at most SAMPLE labelled rows that are not held out; the weights (4 MB) come back."""
    known = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("y").alias("y"))
    )
    docs = small_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    known = known.join(docs.select("id"), "id", "left_semi")
    rank = F.xxhash64(F.lit(5), "id")
    few = [known.filter(F.col("y") == y).orderBy(rank, "id").limit(SAMPLE[y]) for y in (0, 1)]
    few = F.broadcast(few[0].unionByName(few[1]))  # at most sum(SAMPLE) ids
    # sizes first, so that no task ever holds more texts than the bound
    sizes = docs.join(few, "id").groupBy("id", "y").agg(F.max(F.octet_length("text")).cast("long").alias("size"))
    few = F.broadcast(sizes.repartition(1).sortWithinPartitions(rank, "id").mapInArrow(_that_fit, "id long, y int"))
    # of several texts of an id the last in order
    sample = docs.join(few, "id").groupBy("id", "y").agg(F.max("text").alias("text")).select("id", "text", "y").repartition(1)

    def go(batches):
        rows = sorted(row for b in batches for row in zip(*(b.column(i).to_pylist() for i in (0, 1, 2))))
        weights = train([r[1] for r in rows], np.array([r[2] for r in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    found = sample.mapInArrow(go, "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else train([], np.zeros(0))


def toxicity(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of every whole text.

    Only the text is scored; null counts as empty. Labels of held-out ids (crc32 of the id modulo 5 is 0), null labels
    and labels without a row are not used; of several labels of an id the largest counts. Without labels of both classes
    every score is that of the one there is, of class 0 if there is none. Repeated rows stay. Training is bounded by SAMPLE; scoring is one narrow pass.
    """
    weights = fit(df, labels, id_col, text_col, label_col)
    id_ = F.col(f"`{id_col}`").cast("long")
    docs = df.select(id_.alias("doc_id"), held_out(id_).alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def go(batches):
        for batch in batches:
            s = score(batch.column(2).to_pylist(), weights)
            cols = [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(go, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Rows of df, all columns, whose text is not predicted to be toxic."""
    weights = fit(df, labels, id_col, text_col, label_col)

    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        return pd.Series(score(texts.fillna("").tolist(), weights) < 0.5)

    return df.filter(clean(F.col(f"`{text_col}`")))
