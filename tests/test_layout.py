"""Reading order of boxes against a recursive cut."""

import random

from pyspark.sql import functions as F

from quillflow.operators import layout as L


def parts(boxes, low, high, least):
    out, reach, gaps = [], None, []
    for b in sorted(boxes, key=lambda b: (b[low], b[high], b[0])):
        if reach is not None and b[low] - reach >= least:
            gaps.append(b[low] - reach)
            out.append([b])
        elif out:
            out[-1].append(b)
        else:
            out.append([b])
        reach = b[high] if reach is None else max(reach, b[high])
    return out, max(gaps, default=0)


def cut(boxes, level):
    """Ids in reading order; a box is (id, x0, y0, x1, y1)."""
    if level:
        (x, wide), (y, high) = parts(boxes, 1, 3, L.GAP_X), parts(boxes, 2, 4, L.GAP_Y)
        if wide or high:
            return [i for p in (x if wide >= high else y) for i in cut(p, level - 1)]
    return [b[0] for b in sorted(boxes, key=lambda b: (b[2], b[1], b[0]))]


def test_random_pages(spark):
    rng, rows = random.Random(8), []
    for page in range(60):
        for k in range(rng.randint(1, 25)):
            x, y = rng.choice([0, 60, 130, 300, 310]) + rng.random() * 8, rng.randint(0, 30) * 14.0
            rows.append((page, k, x, y, x + rng.choice([40, 100, 250]), y + 11))
    df = spark.createDataFrame(rows, "page int, id int, x0 double, y0 double, x1 double, y1 double").repartition(3).withColumn("_x", F.lit("clash")).drop("_x")
    found = {}
    for r in L.reading_order(df, "page", "id").orderBy("page", "number").collect():
        found.setdefault(r["page"], []).append(r["id"])
    assert found == {p: cut([r[1:] for r in rows if r[0] == p], L.LEVELS) for p in range(60)}


def test_columns_below_a_title(spark):
    boxes = [(1, 0, 50.0, 10.0, 500.0, 30.0), *[(1, 10 + k, 50.0, 60.0 + 14 * k, 250.0, 71.0 + 14 * k) for k in range(5)], *[(1, 20 + k, 300.0, 60.0 + 14 * k, 500.0, 71.0 + 14 * k) for k in range(5)], (1, 90, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(boxes, "page int, id int, x0 double, y0 double, x1 double, y1 double")
    out = L.reading_order(df, "page", "id").orderBy("number").collect()
    assert [r["id"] for r in out] == [0, 10, 11, 12, 13, 14, 20, 21, 22, 23, 24, 90]
    assert [r["region"] for r in out][:2] == [[0], [1, 0]] and out[-1]["region"] is None
    assert L.reading_order(df.limit(0), "page", "id").count() == 0


def test_headings(spark):
    rows = [(1, "Title", 24.0), (1, "Part", 14.0), (1, "long text of the page " * 5, 10.0), (1, "note", 8.0), (1, "Part two", 14.0), (2, "only", 10.0), (2, "none", None)]
    df = spark.createDataFrame(rows, "page int, text string, size double")
    assert {r["text"][:8]: r["heading_level"] for r in L.headings(df, "page", "size").collect()} == {"Title": 1, "Part": 2, "long tex": None, "note": None, "Part two": 2, "only": None, "none": None}


def test_shares_do_not_grow_with_the_table(spark, monkeypatch, tmp_path):
    """More boxes are dealt to more tasks, in the one shuffle that windows over pages need anyway, with the same order."""
    from quillflow.plans import registry

    rows = [(o, n, o * 7 + n, o + n * 3, float(o % 5 + n)) for o in range(400) for n in range(1, 4)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    box_order = registry.queries()["box_order"]
    expected = sorted(map(tuple, box_order(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(L, "TASK_BOXES", 100)
    df = box_order(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 12 and sorted(map(tuple, df.collect())) == expected and len(expected) == len(rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan")[0].count("Exchange ") == 1
