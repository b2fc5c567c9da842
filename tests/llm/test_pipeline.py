"""The pipeline's stages on the smallest tables, each against what its own input calls for."""

import hashlib

import pytest

import corpus_pipeline as P
from quillflow.llm.queries import oracle_sql, queries


def test_stages(spark, sf_dir):
    from quillflow.llm.stored import stored

    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in P.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        seen.append((name, before, docs))
    for name, before, after in seen[:-1]:
        assert after.schema == before.schema, name
    toxic, lines, near, mixed, ids = [x[2] for x in seen]
    assert 0 < toxic.count() <= seen[0][1].count() and lines.count() == toxic.count()
    assert {r[0] for r in near.select("doc_id").collect()} <= {r[0] for r in lines.select("doc_id").collect()}
    kept = [r[0] for r in lines.select("text").collect()]
    every = [x for t in kept for x in t.split("\n") if x.strip()]
    assert len(every) == len(set(every))
    assert near.groupBy("doc_id").count().filter("count > 1").count() == 0
    assert mixed.groupBy("doc_id").count().filter("count > 2").count() == 0
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert ids.count() == mixed.count()
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and len(r["token_ids"]) == r["n_tokens"] for r in ids.collect())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with labels, and documents with null ids, null and empty texts, repeated rows and a null source."""
    folder = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame([(k, 0) for k in range(4)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    word = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(k, word(k), "en", f"s{k % 2}", 9) for k in range(8)]
    rows += [(None, word(20), None, None, None), (None, word(21), "en", None, 1), (None, word(21), "en", None, 1), (9, None, "en", "s0", 0), (10, "", "en", "s0", 0), (3, word(3), "en", "s1", 9)]
    return folder, rows


def test_stages_on_odd_rows(spark, small):
    """Each stage keeps the columns; distinct texts, with or without an id, all reach the mix."""
    from quillflow.llm.stored import stored

    folder, rows = small
    docs = spark.createDataFrame(rows, COLUMNS)
    for name, stage in P.STAGES[:3]:
        docs = stored(stage(spark, docs, folder))
        assert [f.name for f in docs.schema] == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r["text"] for r in docs.collect() if r["text"]} == {t for _, t, *_ in rows if t}
    mixed = stored(P.STAGES[3][1](spark, docs, folder))
    assert mixed.count() >= docs.filter("text <> ''").count() and P.STAGES[4][1](spark, mixed, folder).count() == mixed.count()


def test_stages_on_an_empty_table(spark, small):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, small[0])
        assert docs.count() == 0


def test_a_cluster_needs_a_shared_folder():
    from quillflow.llm.stored import shared_dir

    class Conf(dict):
        set = dict.__setitem__

    session = lambda master: type("S", (), {"conf": Conf(), "sparkContext": type("C", (), {"master": master})()})()
    assert shared_dir(session("local[4]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))


def test_scratch_tables_are_deleted(spark):
    import os

    from quillflow.llm.stored import scratch, stored

    with scratch(spark):
        kept = stored(spark.range(3))
        path = kept.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))


def test_every_operator_has_a_query():
    names = sorted(int(k[2:].split("_")[0]) for k in queries())
    assert names == list(range(1, 14)) and set(oracle_sql()) <= set(queries()) and 4 <= len(P.STAGES) <= 5
