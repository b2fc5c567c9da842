"""Nearest neighbours of vectors of unequal length and of several dimensions, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillflow.llm import ann


def recall(spark, v, k=20):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=k).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, len(v), 20):
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score)[:k].tolist()))
    return hits / k / len(range(0, len(v), 20))


def unit(n, dim, rng):
    v = rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("spread", [0.3, None])
def test_unequal_lengths(spark, monkeypatch, spread):
    rng = np.random.default_rng(3)
    v = unit(4000, 64, rng)
    if spread:
        monkeypatch.setattr(ann, "WHOLE", 200)
        v *= rng.lognormal(0, spread, 4000)[:, None]
    else:
        v[7] *= 10
    assert recall(spark, v) >= 0.95


def test_several_rotations(spark, monkeypatch):
    """Buckets named by two rotations, as in a table of many millions; clustered vectors, whose neighbours are near."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(ann, "BUCKET", 4)
    monkeypatch.setattr(ann, "CHUNK", 64)
    assert ann.layout(4000, 32)[0] == 2
    centres = unit(100, 32, rng)
    v = centres[rng.integers(0, 100, 4000)] + 0.08 * rng.normal(size=(4000, 32))
    assert recall(spark, v / np.linalg.norm(v, axis=1)[:, None]) >= 0.93


def test_layout_keeps_buckets_small():
    for n in (10**3, 10**6, 10**8, 10**10):
        functions, last = ann.layout(n, 64)
        buckets = 128 ** (functions - 1) * 2 * last
        assert n <= 4096 * buckets and (functions == 1 or n > 1024 * buckets)


def test_dimensions(spark):
    rng = np.random.default_rng(4)
    v = [*unit(60, 8, rng), np.ones(9), *unit(5, 3, rng)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df, F.lit(True), k=20).orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    for q, x in enumerate(v):
        score = {i: float(y @ x) for i, y in enumerate(v) if i != q and len(y) == len(x)}
        best = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert found.get(q, []) == best


def test_too_few_probes_mean_a_whole_search(spark, monkeypatch):
    monkeypatch.setattr(ann, "MOST_PROBES", 1)
    monkeypatch.setattr(ann, "WHOLE", 50)
    monkeypatch.setattr(ann, "BUCKET", 8)
    monkeypatch.setattr(ann, "TABLES", 2)
    assert recall(spark, unit(3000, 32, np.random.default_rng(9))) == 1.0
