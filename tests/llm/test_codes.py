"""Vector codes against plain whole-number arithmetic, and the screening against exact distances."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillflow.llm import codes, vectors


def brute_force(rows, parts, entries, rounds):
    """rows: (id, label, vector), all of one length. Python integers throughout."""
    x = [[int(np.floor(256 * float(c))) for c in v] for *_, v in rows]
    dim = len(x[0])
    cut = [dim * p // parts for p in range(parts + 1)]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][2]))[:entries]
    books = [[x[k][a:b] for k in order] for a, b in zip(cut, cut[1:])]
    near = lambda v, book: min((sum((p - q) ** 2 for p, q in zip(v, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for v in x:
                part = v[cut[p] : cut[p + 1]]
                own.setdefault(near(part, book)[1], []).append(part)
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else c for e, c in enumerate(book)]
    best = [[near(v[cut[p] : cut[p + 1]], books[p]) for p in range(parts)] for v in x]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error, total = [sum(d for d, _ in b) for b in best], {}
    for (_, label, _), e in zip(rows, error):
        total[label] = total.get(label, 0) + e
    return [(i, "".join(f"{e:02x}" for _, e in b), e, total[label], sha) for (i, label, _), b, e in zip(rows, best, error)]


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("dim, parts, entries", [(8, 4, 8), (10, 4, 5), (3, 5, 4)])
def test_compress(spark, dim, parts, entries):
    rng = np.random.default_rng(2)
    rows = [(k, int(k % 3) or None, rng.normal(0, 0.1, dim).tolist()) for k in range(200)]
    rows += [(300 + k, 1, [0.25 * (k % 2)] * dim) for k in range(20)]  # ties
    rows += [(5, 2, rng.normal(0, 50.0, dim).tolist()), (None, 2, [-1000.0] * dim), (-4, None, [1e5] * dim), (-4, None, [1e5] * dim)]
    bad = [(900, 1, None), (901, 1, []), (902, 1, [float("nan")] * dim), (903, 1, [float("inf")] * dim), (904, 1, [None] * dim), (905, 1, [1e300] * dim)]
    df = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<double>").repartition(3).withColumns({c: F.lit("clash") for c in ("code", "n", "part", "of", "id")})
    assert got(codes.compress(df, parts=parts, entries=entries)) == sorted(brute_force(rows, parts, entries, 2), key=str)


def test_lengths_apart(spark):
    rng = np.random.default_rng(4)
    rows = [(k, 1, rng.normal(0, 1, (4, 8)[k % 2]).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    as_float = [(i, label, [float(np.float32(c)) for c in v]) for i, label, v in rows]
    out = [brute_force([r for r in as_float if len(r[2]) == n], 2, 16, 2) for n in (4, 8)]
    total = sum(r[2] for part in out for r in part)
    assert got(codes.compress(df, parts=2, entries=16)) == sorted(((i, c, e, total, s) for part in out for i, c, e, _, s in part), key=str)


def test_no_vectors(spark):
    for rows in ([], [(1, 1, None)]):
        assert codes.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).count() == 0
    with pytest.raises(ValueError):
        codes.compress(None, entries=300)


@pytest.mark.parametrize("size", [3, 10**4, 10**6, vectors.limit(8)])
def test_screening_holds(size):
    """Every true score lies in its interval, and the nearest entry is exact where float32 cannot tell entries apart."""
    rng = np.random.default_rng(size)
    x, book = rng.integers(-size, size + 1, (2000, 8)), rng.integers(-size, size + 1, (64, 8))
    book[7], book[9] = book[50], book[3] + (np.arange(8) == 2)
    x[:64] = book
    x[64:1000] = book[rng.integers(0, 64, 936)] + rng.integers(-2, 3, (936, 8))
    x = np.clip(x, -size, size)
    score, _, error = codes.screened(x, book)
    true = (book.astype(object) ** 2).sum(1)[None, :] - 2 * x.astype(object) @ book.astype(object).T
    off = np.abs(score.astype(np.float64) - true.astype(np.float64))
    assert (off <= error[:, None] + np.abs(true.astype(np.float64)) * 2.0**-50).all()
    far = ((x.astype(object)[:, None, :] - book.astype(object)[None]) ** 2).sum(2)
    index, distance = codes.nearest_entries(x, book)
    assert index.tolist() == [min(range(64), key=lambda e: (row[e], e)) for row in far.tolist()]
    assert distance.tolist() == far.min(1).tolist()
