"""Near-duplicates by five-word shingles against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillflow.llm import neargroups


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_force(rows):
    """Rows that stay: of each component of similarity 0.8 or more the one with the smallest id."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                group = [group[b] if g == group[a] else g for g in group]
    return [{rows[k] for k in range(len(rows)) if group[k] == g} for g in set(group)]


def table():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioustrnlm") for _ in range(7))
    rows = []
    for k in range(120):  # pairs of similarity 0.75 to 0.97
        w = [word() for _ in range(rng.choice([64, 200]))]
        copy = list(w)
        for at in rng.sample(range(len(w)), max(1, len(w) * (k % 6) // 200)):
            copy[at] = word()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(copy))]
    base = [word() for _ in range(300)]
    for k in range(40):  # copies of one text, most of them less alike to one another than to it; more than a bucket's first round
        copy = list(base)
        for at in rng.sample(range(300), 4):
            copy[at] = word()
        rows.append((1000 + k, " ".join(copy)))
    rows += [(None, " ".join(word() for _ in range(50))) for _ in range(5)]
    rows += [(7000, " ".join(word() for _ in range(50))), (7000, " ".join(word() for _ in range(50))), (7000, rows[0][1]), (None, rows[0][1]), (7001, None), (7002, " \n"), (7003, "a b")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_one_of_each(spark, monkeypatch, small):
    if small:  # many tables, and buckets in parts
        monkeypatch.setattr(neargroups, "BUCKET", 16)
        monkeypatch.setattr(neargroups, "CHUNK", 8)
        monkeypatch.setattr(neargroups, "MISSED", 1e-7)
        stage = lambda df: neargroups.one_of_each(df, words=5, similarity=0.8, chunk=8)
    else:
        stage = lambda df: corpus_pipeline.drop_near_duplicates(spark, df, "")
    rows = table()
    rows += [rows[4]]
    groups = brute_force(rows)
    assert 100 < len(groups) < 200
    for shift in (0, 1):
        df = spark.createDataFrame(rows[::-1] if shift else rows, "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))
        found = [(r["doc_id"], r["text"]) for r in stage(df).collect()]
        assert len(found) == len(groups)
        for g in groups:
            (stay,) = [r for r in found if r in g]
            assert stay[0] == min((i for i, _ in g if i is not None), default=None)


def test_no_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neargroups.one_of_each(df).count() == 0


def test_rows_without_or_with_shared_ids(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("aeioustrnlm") for _ in range(7)) for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (2, d), (2, e), (3, d), (None, None), (4, "")]
    for data in (rows, rows[::-1]):
        out = neargroups.one_of_each(spark.createDataFrame(data, "doc_id long, text string"))
        assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, a), (None, b), (None, c), (2, d), (2, e), (4, "")], key=str)


@pytest.mark.parametrize("shingles", [60, 300])
@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_recall_of_the_tables(shingles, similarity):
    """Pairs of just the least similarity that share a bucket and pass the limits, as a table of ten million nodes is laid out."""
    rng = np.random.default_rng(8)
    bits, tables = neargroups.layout(10_000_000, 0.8)
    sampled = [rng.choice(192, bits, replace=False) for _ in range(tables)]
    _, coarse, fine = neargroups.limits(0.8)
    found, own = 0, round(shingles * (1 - similarity) / 2)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, shingles + own, np.uint64)
        x, y = (np.array(neargroups.wide_fingerprint(np.sort(p)), np.int64) for p in (pool[own:], np.concatenate([pool[:own], pool[2 * own :]])))
        differ = np.unpackbits((x ^ y).view(np.uint8), bitorder="little")
        found += bool(differ.sum() <= fine and differ[:64].sum() <= coarse and any(not differ[s].any() for s in sampled))
    assert found / 300 >= (0.96 if similarity == 0.8 else 0.995)
