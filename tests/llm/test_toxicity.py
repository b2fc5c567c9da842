"""Training rows of the toxicity classifier."""

import random

import pytest
from pyspark.sql import functions as F

from quillflow.llm import toxicity


def test_labels_without_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", {0: 40, 1: 40})
    rng = random.Random(6)
    words = ["".join(rng.choice("bcdfglmnprt") + rng.choice("aeiou") for _ in range(3)) for _ in range(200)]
    text = lambda toxic: " ".join([rng.choice(words) for _ in range(20)] + ["grzkwort zwifflex"] * 2 * toxic)
    data = [(k, text(k % 2)) for k in range(120)]
    data += [(k, "") for k in range(1, 120, 2)] * 3  # repeated ids, without what their label is for
    labels = [(k, k % 2) for k in range(20_000)]
    df, known = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for rows in (df, df.orderBy("text")):
        found = toxicity.toxicity(rows, known).filter("doc_id < 120").collect()
        right = sum(r["predicted"] == (r["doc_id"] % 2) for r in found if r["score"] is not None)
        assert right >= len(found) - 180 - 6  # the empty texts tell nothing
        assert sum(r["predicted"] for r in found) >= 50


@pytest.mark.parametrize("place", ["first", "middle", "last"])
def test_one_text_above_the_bound(spark, monkeypatch, place):
    """It is left out alone: what else is labelled is learnt."""
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 120_000)
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfglmnprt") + rng.choice("aeiou") for _ in range(3)) for _ in range(200)]
    text = lambda toxic: " ".join([rng.choice(words) for _ in range(20)] + ["grzkwort zwifflex"] * 2 * toxic)
    order = [r["id"] for r in spark.range(300).filter(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64(F.lit(5), "id")).collect()]
    huge = order[{"first": 0, "middle": len(order) // 2, "last": -1}[place]]
    data = [(k, "filler " * 20_000 if k == huge else text(k % 2)) for k in range(300)]
    df, known = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    found = toxicity.toxicity(df, known).filter("held_out").collect()
    assert len(found) > 40 and all(r["predicted"] == r["doc_id"] % 2 for r in found)
