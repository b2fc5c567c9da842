"""Line dedup of documents with odd ids, and of very long lines."""

import random

from quillflow.llm import lines


def test_negative_ids(spark):
    near = "a line that is long enough to count as edited %s"
    data = [
        (-1, "first of all\nsecond line\n\n" + near % "x" + "\nsecond line\nlast line"), (-(1 << 62), "only\nin\nthis"), (-2, "other\n" + near % "y"),
        (0, "last line\nown line"), (1, near % "xz"),
    ]
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found == {
        -1: ("first of all\nsecond line\n\nlast line", 2), -(1 << 62): ("only\nin\nthis", 0), -2: ("other\n" + near % "y", 0), 0: ("own line", 1), 1: ("", 1),
    }


def test_shared_and_missing_ids(spark):
    data = [(1, "one line\nanother"), (1, "other text\none line"), (None, "another\nits own"), (None, "another\nits own"), (None, "third\nits own"), (0, None)]
    out = lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string"))
    left = [x for r in out.collect() for x in (r["text"] or "").split("\n") if x]
    assert sorted(left) in (sorted(["one line", "another", "other text", "third", "its own"]), sorted(["one line", "another", "other text", "third", "its own", "its own"]))
    assert out.count() == len(data) and {r["n_lines"] for r in out.collect()} == {0, 2}


def test_long_lines_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(lines, "STEP", 64)
    monkeypatch.setattr(lines, "ROWS", 200)
    monkeypatch.setattr(lines, "_powers", [])
    rng = random.Random(9)
    base = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (40, 64, 65, 128, 1000)]
    data = [(0, "\n".join(base))]
    for k in range(1, 30):
        x = rng.choice(base)
        at = rng.randrange(len(x))
        data.append((k, rng.choice([x[:at] + "Z" + x[at + 1 :], x[:at] + x[at + 1 :], x[:at] + "Z" + x[at:], x[:at] + "ZZ" + x[at:]])))
    far = [t for _, t in data[1:] if "ZZ" in t]
    out = lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string"))
    kept = {r["text"] for r in out.collect() if r["doc_id"] and r["text"]}
    assert far and kept <= set(far) and out.filter("doc_id > 0 and n_removed = 1").count() >= 29 - len(far)


def test_every_length(spark):
    df = spark.createDataFrame([(1, "ab\nx"), (2, "abc\ny\nq1")], "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, min_chars=1).collect()}
    assert found == {1: "ab\nx", 2: "q1"} and lines.dedup_lines(df).filter("n_removed > 0").count() == 0
