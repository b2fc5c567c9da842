from decimal import Decimal

from pyspark.sql import functions as F

from quillflow.operators import caches, naming, pages, render, routing, runs, usage


def test_footers(spark):
    rows = [(1, p, f"body {p}\ntext\nFooter\n{p}") for p in range(1, 5)] + [(2, 1, "a\nFooter")]
    df = spark.createDataFrame(rows, "book int, page int, text string")
    assert [tuple(r) for r in pages.repeated_footers(df, "book", "page", "text").filter("line = 'Footer'").collect()] == [(1, "Footer", 4, 4)]
    left = {(r[0], r[1]): r[2] for r in pages.without_footers(df, "book", "page", "text").collect()}
    assert left[1, 1] == "body 1" or left[1, 1].startswith("body 1\n") and "Footer" not in left[1, 1]
    assert left[2, 1] == "a\nFooter"


def test_repeats(spark):
    block = "a block of text that is long enough"
    df = spark.createDataFrame([(1, f"{block}\n\n{block}\n{block}\nx"), (2, "end\n" + "loop of some words here\n\n" * 8)], "id int, text string")
    assert pages.repeated_blocks(df, "id", "text").filter("key = 1").count() == 2
    assert [(r["key"], r["copies"]) for r in pages.repeated_tails(df, "id", "text").collect()] == [(2, 8)]


def test_table_warnings(spark):
    df = spark.createDataFrame([(1, "| a | b |\n| --- | --- |\n| 1 |\n\n| x |\n| y \\| z |")], "id int, text string")
    assert [tuple(r) for r in pages.table_warnings(df, "id", "text").collect()] == [(1, 2, 1, 2)]


def test_names(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "id int, name string")
    assert [r[2] for r in naming.unique_names(df, "name", ["id"]).orderBy("id").collect()] == ["A", "a.v2", "b"]
    old = spark.createDataFrame([("a",), ("a.v3",)], "name string")
    plan = lambda policy: {r["id"]: (r["action"], r["target"]) for r in naming.plan_outputs(df, old, "name", policy).collect()}
    assert plan("rename") == {1: ("write", "A.v4"), 2: ("write", "a.v4"), 3: ("write", "b")}
    assert plan("skip")[1] == ("skip", "A") and plan("overwrite")[2] == ("replace", "a")


def test_url_list(spark):
    df = spark.createDataFrame([(1, "\ufeffhttp://a 'Report'\n# no\n\nhttp://b\r\nhttp://a 'Report'")], "id int, text string")
    found = naming.parse_url_list(df, "id", "text")
    assert [tuple(r) for r in found.orderBy("place").collect()] == [(1, 1, "http://a", "Report"), (1, 4, "http://b", None), (1, 5, "http://a", "Report")]
    assert naming.first_of_each(found, F.concat_ws(" ", "url", "name"), ["place"]).count() == 2


def test_json_url_list(spark):
    df = spark.createDataFrame([(2, '["http://a", {"url": "http://b", "output_name": "B"}, 5, {"x": 1}]')], "id int, text string")
    found = [tuple(r) for r in naming.parse_url_list(df, "id", "text").filter("url like 'http%'").orderBy("place").collect()]
    assert found == [(2, 1, "http://a", None), (2, 2, "http://b", "B")]


def test_prices(spark):
    tariffs = spark.createDataFrame([("m", 0, 10, 4, 6), ("m", 20, 100, 8, 12)], "model string, low long, high long, input long, output long")
    rows = [("m", 10, 5, 3, False), ("m", 15, 0, 1, False), ("m", 20, 0, 1, True), ("x", 1, 0, 1, False)]
    df = spark.createDataFrame(rows, "model string, prompt_tokens long, cached_tokens long, completion_tokens long, batch boolean")
    got = [r["cost_usd"] for r in usage.quote(df, tariffs).orderBy("prompt_tokens").collect()]
    assert got == [None, Decimal("0.000000000040"), None, Decimal("0.000000000086")]


def test_usage(spark):
    rows = [("a", 1, 10, 2, Decimal("0.5")), ("a", 2, 5, 1, None), ("b", 1, 1, 1, None)]
    merged = usage.merge_usage(spark.createDataFrame(rows, "model string, requests long, input_tokens long, output_tokens long, cost_usd decimal(38,12)"))
    got = {r["model"]: (r["requests"], r["cost_usd"], r["priced_requests"]) for r in merged.collect()}
    assert got == {"a": (3, Decimal("0.5"), 1), "b": (1, None, 0)}


def test_replay_and_resume(spark):
    ev = spark.createDataFrame([("k", 1, "running", "o1"), ("k", 3, "completed", None), ("k", 2, "failed", "o2"), ("j", 1, "running", None)], "key string, seq int, status string, output string")
    got = {r["key"]: (r["status"], r["output"], r["applied"]) for r in runs.replay(ev, "key", "seq", ["output"], "status").collect()}
    assert got == {"k": ("completed", "o2", 3), "j": ("failed", None, 1)}
    saved = spark.createDataFrame([("a", "completed"), ("b", "failed")], "key string, status string")
    found = spark.createDataFrame([("b",), ("c",)], "key string")
    assert sorted(tuple(r) for r in runs.resume(saved, found, "key").collect()) == [("a", "completed", False, True), ("b", "failed", True, False), ("c", "pending", True, False)]


def test_lru_and_ttl(spark):
    rows = spark.createDataFrame([(1, "s", 5, 1), (2, "s", 5, 2), (3, "s", 5, 3)], "id int, shard string, size int, at int")
    assert [r[0] for r in caches.lru_evict(rows, ["shard"], "size", "at", "id", 10).filter("evicted").collect()] == [1]
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    cache = spark.sql("select 'a' key, timestamp'2024-01-01 00:00:00' created_at union all select 'b', timestamp'2023-01-01 00:00:00'")
    assert {r["key"]: r["state"] for r in caches.lookup(items, cache, "key", F.lit("2024-01-01 01:00:00").cast("timestamp"), 7200).collect()} == {"a": "hit", "b": "stale", "c": "miss"}


def test_rendering(spark):
    df = spark.createDataFrame([("T: x", "s", ["a", "no"], "body")], "title string, source string, tags array<string>, markdown string")
    text = render.render(df, {"tags": F.col("tags"), "source": F.col("source"), "title": F.col("title")}).first()["rendered"]
    assert text == "---\ntitle: 'T: x'\nsource: s\ntags:\n- a\n- 'no'\n---\n\nbody"
    meta = F.create_map(F.lit("source"), F.lit("u"))
    once = render.okf(meta, "me", F.lit("2024-01-01").cast("timestamp"))
    a, b = spark.range(1).select(once.alias("a"), render.okf(once, "me", F.lit("2025-01-01").cast("timestamp")).alias("b")).first()
    assert a == b == {"type": "Document", "resource": "u", "generated": "me 2024-01-01T00:00:00Z"}


def test_publish(spark, tmp_path):
    df = spark.createDataFrame([("a.md", "x"), ("d/b.md", "y")], "target string, rendered string")
    assert render.publish_files(df, str(tmp_path)) == 2 and (tmp_path / "d/b.md").read_text() == "y" and not list(tmp_path.glob("**/*.part"))


def test_readers_by_extension(spark):
    df = spark.createDataFrame([("x/A.DOCX",), ("b.tsv",), ("c",), ("d.zzz",)], "path string")
    assert [r["reader"] for r in routing.with_reader(df, "path").collect()] == ["word", "delimited", None, None]


def test_streaming(spark, tmp_path):
    from quillflow.functions import urls as U
    from quillflow.streaming import ingest

    page = "<article><h1>H{}</h1><p>text</p></article>"
    rows = [(k, f"http://e.com/{k % 3}", page.format(k)) for k in range(5)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    stream = ingest.pages_stream(spark, str(tmp_path / "in"))
    name = lambda df: df.select("key", "url", U.output_name(F.col("url")).alias("name"))
    ingest.convert_and_publish(stream, str(tmp_path / "out"), str(tmp_path / "cp"), name).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["target"] for r in out.collect()) == ["0", "1", "2"] and out.filter("error is null").count() == 3


def test_dates_of_long_identifiers(spark, tmp_path):
    """Numbers whose ticks and post ids go beyond 64 bits, and years of five digits."""
    from datetime import datetime, timedelta

    from quillflow.plans import registry

    ids = [0, 1, 1317624, 1317625, 2932896, 2932897, 5999999, 90_000_000]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    out = {r["event_id"]: (r["filetime"], r["posted"]) for r in registry.queries()["id_dates"](spark, str(tmp_path)).collect()}
    at = lambda i: datetime(1970, 1, 1) + timedelta(milliseconds=((i * 7000000000000) >> 22) + 1288834974657)
    assert {i: out[i][1] for i in ids} == {i: f"{at(i):%Y-%m-%dT%H:%M:%SZ}" if i else None for i in ids}
    assert [out[i][0] for i in (0, 2932896, 2932897, 5999999)] == ["1970-01-01T00:00:00Z", "9999-12-31T00:00:00Z", "10000-01-01T00:00:00Z", "18397-06-10T00:00:00Z"]
    exact = spark.range(1).select(routing.from_filetime(F.lit(116444736000000000 - 1)).alias("a"), routing.from_filetime(F.lit(116444736000000000 + 90071992547409931)).alias("b"))
    assert exact.select(F.unix_micros("a"), F.unix_micros("b")).first()[:] == (-1, 9007199254740993)
