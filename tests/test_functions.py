from pyspark.sql import functions as F

from quillflow.functions import tails, markdown as M, text as T, urls as U


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()[0]


def test_word_count(spark):
    for text, n in (("Hello, world! **Bold** text_here 42", 5), ("中文 字数 and English", 6), ("  ", 0)):
        assert one(spark, T.word_count(F.col("t")), t=text) == n


def test_token_estimate_rounds_up(spark):
    assert [one(spark, T.token_estimate(F.col("t")), t=t) for t in ("", "a", "abcde", "中文a")] == [0, 1, 2, 3]


def test_plausible(spark):
    ok = T.plausible(F.col("a"), F.col("b"))
    text = "the quick brown fox jumps over the lazy dog again " * 8
    assert one(spark, ok, a=text, b=text) and not one(spark, ok, a=text, b="unrelated" * 400) and one(spark, ok, a="short", b="x")


def test_fences_cells_titles(spark):
    assert one(spark, T.fence(F.col("t")), t="a ```` b") == "`````"
    assert one(spark, T.table_cell(F.col("t")), t="a|b\r\nc") == "a\\|b<br>c"
    assert one(spark, T.title_of(F.col("t"), F.lit("f")), t="x\n## **A** [b](c) \\_d\n# e") == "A b _d"
    assert one(spark, T.title_of(F.col("t"), F.lit("f")), t="no heading") == "f"


def test_file_names(spark):
    name = T.file_name(F.col("t"))
    cases = {"a/b:c": "a_b_c", " .x. ": "x", "": "unnamed", "con.txt": "_con.txt", "COM1": "_COM1", "console": "console"}
    assert {k: one(spark, name, t=k) for k in cases} == cases
    assert one(spark, name, t="y" * 300 + ".md") == "y" * 177 + ".md"


def test_yaml_scalars(spark):
    cases = {"yes": "'yes'", "2024-01-02": "'2024-01-02'", "12:30": "'12:30'", "plain text": "plain text", "": "''", "a: b": "'a: b'", "it's #1": "'it''s #1'"}
    assert {k: one(spark, T.yaml_scalar(F.col("t")), t=k) for k in cases} == cases


def test_sizes_and_durations(spark):
    assert [one(spark, T.byte_size(F.col("n")), n=n) for n in (5, 1536, 5 << 20)] == ["5 B", "1.5 KB", "5.0 MB"]
    assert [one(spark, T.duration(F.col("n")), n=n) for n in (1.2, 61.0, 3725.0)] == ["1.2s", "01:01", "01:02:05"]


def test_url_names(spark):
    cases = {
        "https://example.com/": "example_com", "https://www.youtube.com/watch?v=abc": "www_youtube_com_watch_abc",
        "https://example.com:8080/search?q=x": "example_com_8080_search", "https://example.com/p?id=../../etc": "example_com_p_etc",
        "https://example.com/doc?token=zzz": "example_com_doc", "https://example.com/a/b%20c/": "b c",
    }
    assert {k: one(spark, U.output_name(F.col("u")), u=k) for k in cases} == cases


def test_redaction(spark):
    cases = {
        "https://u:p@e.com/a?x=1": "https://e.com/a?x=1", "https://e.com/?api-key=1&b=2#f": "https://e.com/?api-key=REDACTED&b=2#f",
        "https://e.com/?page=2": "https://e.com/?page=2", "https://e.com/?authCode=1": "https://e.com/?authCode=REDACTED",
    }
    assert {k: one(spark, U.redact(F.col("u")), u=k) for k in cases} == cases


def test_opaque(spark):
    assert one(spark, U.is_opaque(F.col("s")), s="aB3dE5fG7hJ9kL1mN3pQ5rS7") and not one(spark, U.is_opaque(F.col("s")), s="0123456789abcdef0123456789abcdef")


def test_globs():
    import re

    assert re.match(U.glob_pattern("docs/*.md"), "docs/a.md") and not re.match(U.glob_pattern("docs/*.md"), "docs/x/a.md")
    assert re.match(U.glob_pattern("**/a.md"), "x/y/a.md")


def test_markdown_clean_is_idempotent():
    for text in ("# A\ntext  \nmore \n\n\n\nend\n```\n\n\n x \n```", "poem  \nline  \n\n\nx", "", "\n\n", "## a\n## b\nc"):
        once = M.clean(text)
        assert M.clean(once) == once
    assert M.clean("a\n# H\nb\n\n\n\nc  ") == "a\n\n# H\n\nb\n\nc\n"
    assert M.clean("```\n# code  \n\n\n\n```") == "```\n# code  \n\n\n\n```\n"


def test_protect_and_chunks():
    text = "a `code` [l](http://x.y) $$z$$\n```\nfence\n```\n<b>t</b> https://e.com/q end"
    bare, literals = M.protect(text)
    assert len(literals) == 7 and M.restore(bare, literals) == text and "http" not in bare
    long = "para one\n\n" * 30 + "x" * 250
    pieces = M.split_chunks(long, 100)
    assert "".join(pieces) == long and max(map(len, pieces)) <= 100


def test_periodic_tail():
    assert tails.salvaged("start " + "the same sentence again. " * 9)
    assert tails.salvaged("nothing repeats here at all") is None and tails.salvaged("." * 500) is None


def test_private_hosts(spark):
    """A host that ends in a number and is no valid IPv4 literal is not public."""
    closed = ["http://192.168.1.256/", "http://192.168.1.1001/", "http://8.8.8.300/", "http://127.1/", "http://1.2.3.4.5/", "http://a.0x7f/", "http://10.0.0.1/", "http://wiki.internal/", "http://host/"]
    public = ["http://8.8.8.8/", "http://192.169.1.1/", "https://e.com/", "https://e1.com2/", "https://1.e.com/"]
    rows = spark.createDataFrame([(u,) for u in closed + public], "url string").select("url", U.is_private(F.col("url")).alias("p")).collect()
    assert {r["url"] for r in rows if r["p"]} == set(closed) and all(r["p"] is not None for r in rows)
