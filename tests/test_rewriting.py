"""References in Markdown and HTML: tokens, rewriting in all forms, and what stays."""

import random

import pytest
from pyspark.sql import functions as F

from quillflow.functions import targets as G
from quillflow.operators import rewriting as R

TEXT = """---
link: "[x](assets/a.png)"
---
See [a](assets/a.png "t"), ![b](<assets/b c.png>), [![i](assets/a.png)](assets/d.png?x=1#top) and [p](assets/p\\(1\\).png).
`[c](assets/a.png)` \\[no](assets/a.png) ``a ` [c](assets/a.png)`` $[m](assets/a.png)$

[ref]: ./assets/a.png 'x'
[^1]: assets/a.png

![[assets/a.png|alt]] and [[assets/d.png#head]]

<img src="assets/a.png" srcset="assets/a.png 1x, assets/d.png 2x" style="background:url('assets/a.png')"> <!-- [x](assets/a.png) -->
<style>p{background:url(assets/a.png)} /* url(assets/a.png) */ @import "assets/d.png";</style>
<pre>[x](assets/a.png)</pre>

```
[z](assets/a.png)
```

~~~ open
[q](assets/a.png)
"""
MOVED = [("assets/a.png", "new/a b.png"), ("assets/b c.png", "new/b.png"), ("assets/d.png", "new/d(1).png"), ("assets/p(1).png", "new/p.png"), ("nothing", "x"), ("assets/a.png", "new/later.png")]


def test_tokens_are_the_text():
    assert [t for t in G.tokens(TEXT) if t[0]] == [
        ("inline", "assets/a.png"), ("inline", "<assets/b c.png>"), ("inline", "assets/a.png"), ("inline", "assets/d.png?x=1#top"), ("inline", "assets/p\\(1\\).png"), ("definition", "./assets/a.png"),
        ("wiki", "assets/a.png"), ("wiki", "assets/d.png"), ("attribute", "assets/a.png"), ("srcset", "assets/a.png"), ("srcset", "assets/d.png"), ("css", "assets/a.png"),
        ("comment", "<!-- [x](assets/a.png) -->"), ("css", "assets/a.png"), ("css", "assets/d.png"),
    ]
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["[", "]", "(", ")", "`", "``", "```", "\n", "\n\n", "a", "b c", "<img src=", '"', "'", ">", "<", "!", "[[", "$", "$$", "\\", "<!--", "-->", ": ", "<style>", "url(", "---\n"]) for _ in range(rng.randrange(40)))
        assert "".join(t for _, t in G.tokens(text)) == text


def test_rewriting(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "no links"), (5, TEXT)], "id int, md string").withColumn("_parts", F.lit("clash"))
    moved = spark.createDataFrame(MOVED, "target string, path string")
    out = R.rewritten(docs, "id", "md", moved)
    found = {r["id"]: r["md"] for r in out.collect()}
    assert out.columns == docs.columns and found[2] is None and found[3] == "" and found[4] == "no links" and found[5] == found[1]
    lines = found[1].split("\n")
    assert lines[3] == 'See [a](new/a%20b.png "t"), ![b](<new/b.png>), [![i](new/a%20b.png)](new/d\\(1\\).png?x=1#top) and [p](new/p.png).'
    assert lines[4] == TEXT.split("\n")[4] and lines[1] == TEXT.split("\n")[1]
    assert lines[6:8] == ["[ref]: new/a%20b.png 'x'", "[^1]: assets/a.png"]
    assert lines[9] == "![[new/a b.png|alt]] and [[new/d(1).png#head]]"
    assert lines[11] == '<img src="new/a%20b.png" srcset="new/a%20b.png 1x, new/d%281%29.png 2x" style="background:url(\'new/a%20b.png\')"> <!-- [x](assets/a.png) -->'
    assert lines[12] == '<style>p{background:url(new/a%20b.png)} /* url(assets/a.png) */ @import "new/d%281%29.png";</style>'
    assert lines[13:] == TEXT.split("\n")[13:]
    again = {r["id"]: r["md"] for r in R.rewritten(out, "id", "md", moved).collect()}
    assert again == found


def test_rewriting_by_document(spark, monkeypatch):
    monkeypatch.setattr(R, "FEW", 0)  # by a shuffle
    docs = spark.createDataFrame([(1, "[a](x)"), (2, "[a](x)")], "id int, md string")
    moved = spark.createDataFrame([(1, "x", "y")], "id int, target string, path string")
    assert {r["id"]: r["md"] for r in R.rewritten(docs, "id", "md", moved).collect()} == {1: "[a](y)", 2: "[a](x)"}
    assert R.rewritten(docs.limit(0), "id", "md", moved).count() == 0


@pytest.mark.parametrize("change, text, want", [
    (R.without_page_markers, "<!-- Page number: 1 -->\n\na\n`<!-- Page number: 2 -->`\n```\n<!-- Slide number: 3 -->\n```\n<!-- other -->", "a\n`<!-- Page number: 2 -->`\n```\n<!-- Slide number: 3 -->\n```\n<!-- other -->"),
    (R.rag_markers, "<!-- Page number: 12 -->\n![a](.x/assets/i.png) `<!-- Page number: 2 -->`", "<!-- page: 12 -->\n![a](assets/i.png) `<!-- Page number: 2 -->`"),
    (R.obsidian_images, "![a](assets/i.png) `![a](assets/i.png)` [a](assets/i.png) ![b](.x/assets/j.png) ![c](assets/a%20b.png) ![d](other/i.png)", "![[assets/i.png]] `![a](assets/i.png)` [a](assets/i.png) ![[assets/j.png]] ![c](assets/a%20b.png) ![d](other/i.png)"),
])
def test_profiles(spark, change, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(change(F.col("t"))).first()[0] == want
