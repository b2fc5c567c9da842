"""Hard negatives against plain loops over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillflow.llm import hardneg, vectors


def brute_force(rows, positives=5, k=3):
    once = {}
    for i, label, v in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[2], str(r[1]))):
        once.setdefault(i, (str(label), [int(np.floor(256 * float(c))) for c in v]))
    out = []
    for a in (i for i in once if i % 10 == 0):
        score = {i: sum(p * q for p, q in zip(once[a][1], v)) for i, (_, v) in once.items() if i != a and len(v) == len(once[a][1])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if once[i][0] == once[a][0]][:positives]:
            hit = [i for i in order if once[i][0] != once[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(hit[:k], 1)]
    return sorted(out)


def mined(df):
    return sorted(map(tuple, hardneg.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label")).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many blocks of rows and of anchors, joins instead of broadcasts
        for name, value in (("ROWS", 16), ("NUMBERS", 256), ("ANCHORS", 4), ("SLAB", 3), ("FEW", 0)):
            monkeypatch.setattr(hardneg, name, value)
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (4, 8))
    rows = [(k, int(k % 4), (centres[rng.integers(0, 4)] + rng.normal(0, 0.5, 8)).tolist()) for k in range(300)]
    rows += [(400 + k, k % 2, [0.5] * 8) for k in range(12)]  # ties
    rows += [(500 + k, 0, [-1.0] * 8) for k in range(3)] + [(510, 3, [0.0] * 8), (520, 9, rng.normal(0, 1, 8).tolist()), (-10, 1, rng.normal(0, 1, 8).tolist())]
    rows += [(600 + k, k % 2, rng.normal(0, 1, 5).tolist()) for k in range(20)] + [(30, 2, [9.0] * 8), (7, 2, rows[7][2])]
    bad = [(700, None, [1.0] * 8), (710, 1, None), (720, 1, []), (730, 1, [float("nan")] * 8), (740, 1, [None] * 8), (750, 1, [float("-inf")] * 8), (760, 1, [1e200] * 8)]
    nameless = [(None, 1, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad + nameless, "vec_id long, label int, embedding array<double>").repartition(3)
    df = df.withColumns({c: F.lit("clash") for c in ("id", "v", "a", "b", "asks", "rank", "positives")})
    want = brute_force(rows)
    assert len(want) > 100 and mined(df) == want


def test_few_rows(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert mined(spark.createDataFrame([], kind)) == []
    assert mined(spark.createDataFrame([(10, 1, [1.0])], kind)) == []
    assert mined(spark.createDataFrame([(10, 1, [1.0]), (11, 1, [1.0]), (12, 2, [0.75])], kind)) == [(10, 11, 1, 12, 65536, 49152)]


def test_bounds_and_scores():
    for p in (*range(-300, 300), 2**62 + 77, -(2**62)):
        least, most = (int(x[0]) for x in hardneg.bounds(np.array([p], np.int64), 50, 95))
        assert least == -((-50 * p) // 100) and most == 95 * p // 100
    rng, top = np.random.default_rng(1), vectors.limit(6)
    for size in (100, top):
        a, x = rng.integers(-size, size + 1, (5, 6)), rng.integers(-size, size + 1, (9, 6))
        assert hardneg.scores(a, x).tolist() == (a.astype(object) @ x.T.astype(object)).tolist()
