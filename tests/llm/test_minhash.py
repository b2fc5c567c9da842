"""MinHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillflow.llm import minhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


def brute_force(rows):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                group = [group[b] if g == group[a] else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None), default=None) if sets[k] else i
        out.append((i, len(sets[k]), least, least is None or i == least))
    return sorted(out, key=str)


def table():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioustrnlm") for _ in range(7))
    rows = []
    for k in range(60):  # pairs of similarity 0.7 to 0.97
        w = [word() for _ in range(rng.choice([40, 160]))]
        copy = list(w)
        for at in rng.sample(range(len(w)), max(1, len(w) * (k % 6) // 200)):
            copy[at] = word()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(copy))]
    base = [word() for _ in range(300)]
    for k in range(50):  # copies of one text, most of them less alike to one another than to it
        copy = list(base)
        for at in rng.sample(range(300), 5):
            copy[at] = word()
        rows.append((1000 + k, " ".join(copy)))
    rows += [(999, " ".join(base)), (-5, rows[3][1].upper()), (2000, rows[6][1]), (None, rows[8][1]), (2001, None), (2002, ""), (2003, " \n\t"), (None, ""), (2004, "a b"), (2005, "A  b")]
    rows += [(2006, "a b c"), (2006, "a b c"), (None, "p q r s t"), (None, "p q r s t"), (2007, " ".join(word() for _ in range(30_000))), (2008, "x " * 5000), (2009, "x " * 7000), (2010, "é ß 日本 ü É")]
    return rows


@pytest.mark.parametrize("chunk", [minhash.CHUNK, 8])
def test_near_duplicates(spark, monkeypatch, chunk):
    if chunk == 8:
        monkeypatch.setattr(minhash, "SETS_CHUNK", 8)
    monkeypatch.setattr(minhash, "MISSED", 1e-7)
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("node", "n", "bucket", "label", "component_id", "__id")})
    got = sorted((tuple(r) for r in minhash.near_duplicates(df, chunk=chunk).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == brute_force(rows)


def test_no_table(spark):
    out = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_layout():
    m, width = minhash.layout(10**6, 80)
    assert m * width < 50 and len(minhash.tables(m)) > 80
    assert minhash.layout(10**10, 80)[1] > width and minhash.layout(10, 100) == (2, 3)
    with pytest.raises(ValueError):
        minhash.near_duplicates(None, percent=40)


@pytest.mark.parametrize("size", [12, 60, 400])
def test_recall_of_the_tables(size):
    """Pairs of just the least similarity, and of a little more, that meet in a table and agree in enough minhashes."""
    rng = np.random.default_rng(3)
    m, width = minhash.layout(10**6, 80)
    for both, least in ((0.8, 0.985), (0.88, 0.998)):
        found, shared = 0, int(np.ceil(size * both))
        own = size - shared
        for _ in range(400):
            pool = rng.integers(0, 1 << 63, size, np.uint64)
            sets = [np.sort(pool[: shared + own // 2]), np.sort(np.concatenate([pool[:shared], pool[shared + own // 2 :]]))]
            sig = minhash.signatures(sets, m * width)
            own_ = minhash.collections(sig, width)
            found += bool((own_[0] == own_[1]).sum() >= 2 and (sig[0] == sig[1]).sum() >= minhash.least_agreement(m * width, 80))
        assert found / 400 >= least


def test_a_pair_is_compared_in_its_first_bucket_only():
    rng = np.random.default_rng(1)
    m, width = minhash.layout(1000, 80)
    base = rng.integers(0, 1 << 63, 500, np.uint64)
    sets = [np.sort(np.concatenate([base[: 500 - k], rng.integers(0, 1 << 63, k, np.uint64)])) for k in range(4)]
    sig = minhash.signatures(sets, m * width)
    found = {}
    for t in range(len(minhash.tables(m))):
        bucket = np.full(4, 7 << minhash._table_bits(m) | t, np.int64)
        i, j, _ = minhash.open_pairs(bucket, np.full(4, 500), np.arange(4), sig, np.zeros(4, np.int64), np.arange(4), m, width, 80)
        for pair in zip(i.tolist(), j.tolist()):
            found[pair] = found.get(pair, 0) + 1
    assert found == {(i, j): 1 for i in range(4) for j in range(i)}
