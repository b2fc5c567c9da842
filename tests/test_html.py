"""HTML rules, each on a hand-made page."""

from pyspark.sql import functions as F

from quillflow.plans import documents
from quillflow.sources import blocks as B, html as H


def shown(page, url="https://ex.com/a/b"):
    return [b for b in H.page_blocks(page, url) if b[0] not in ("chrome", "title", "meta")]


def about(page, url="https://ex.com/a/b"):
    return {t.split("\x1f")[0] if k == "meta" else k: t.split("\x1f")[-1] for k, _, t in H.page_blocks(page, url) if k in ("title", "meta")}


def test_forms_keep_prose_and_lose_entry_boxes():
    prose = "word " * 30
    assert shown(f"<form action=/page><p>{prose}</p><input value=x><button>Go</button></form>") == [("paragraph", 0, prose.strip())]
    assert shown(f"<form class=search-box><p>{prose}</p></form>") == [] and shown("<form><label>Name</label></form>") == []
    assert len(shown(f"<form id=newsletter><p>{prose * 3}</p></form>")) == 1


def test_lists():
    page = "<ol start=3><li>a<ol><li>x<li>y</ol><li>b</ol><ul><li>q<ol><li>1</ol></ul>"
    assert shown(page) == [("ordered", 0, "3. a"), ("ordered", 2, "1. x"), ("ordered", 2, "2. y"), ("ordered", 0, "4. b"), ("item", 0, "q"), ("ordered", 1, "1. 1")]


def test_tables():
    rows = lambda page: [tuple(t.split("\x1f")) for k, _, t in shown(page) if k == "row"]
    assert rows("<table><tr><th colspan=2>A<th>B<tr><td rowspan=2>1<td>2<td>3<tr><td>4<td>5</table>") == [("A", "", "B"), ("1", "2", "3"), ("", "4", "5")]
    assert shown("<table><caption>Cap</caption><tr><td>a<td>b<tr><td>c<td>d</table>")[0] == ("paragraph", 0, "Cap")
    assert rows("<table role=presentation><tr><td>a<td>b<tr><td>c<td>d</table>") == [] == rows("<table><tr><td><p>x</p><p>y</p><td>z<tr><td>a<td>b</table>")
    assert rows("<table><tr><td>outer<td><table><tr><td>in<td>er<tr><td>q<td>r</table></table>") == [("in", "er"), ("q", "r")]
    assert rows("<table><tr><td>a<td></td><td>b<tr><td>c<td><td>d</table>") == [("a", "b"), ("c", "d")]
    assert len(rows("<table><thead><tr><td>h<td>i</thead><tr><td>a<td>b</table>")) == 2


def test_code_images_math_and_callouts():
    assert shown("<pre><code class='language-Python'>x = 1\n  y</code></pre>") == [("code", 0, "python\x1fx = 1\n  y")]
    assert shown('<p><img src="data:x"><noscript><img src="/r.png" alt="r"></noscript></p>') == [("paragraph", 0, "![r](https://ex.com/r.png)")]
    assert shown('<p><img srcset="/s.png 100w, /l.png 900w" src="/x.png"><img src=p.gif width=1 height=1></p>') == [("paragraph", 0, "![](https://ex.com/l.png)")]
    assert shown('<math><semantics><mi>x</mi><annotation encoding="application/x-tex">x^2</annotation></semantics></math>') == [("paragraph", 0, "$x^2$")]
    assert shown('<div class="markdown-alert markdown-alert-tip"><p>Tip</p><p>Use it.</p></div>') == [("quote", 0, "[!tip] Tip\nUse it.")]
    assert shown("<article><p>x</p><footer>by me</footer></article><footer>site</footer>") == [("paragraph", 100, "x"), ("paragraph", 100, "by me")]
    assert shown('<div class="hidden">no</div><div class="hidden md:block">yes</div>') == [("paragraph", 0, "yes")]


def test_page_metadata():
    ld = '<script type="application/ld+json">{"@graph":[{"headline":"Big News","author":[{"@type":"Person","name":"A B"},{"@type":"Organization","name":"O"}],"datePublished":"2020-01-01"}]}</script>'
    found = about(f'{ld}<title>Big News | Site</title><meta property="og:site_name" content="Site"><link rel=canonical href="/"><h1>Big News</h1>')
    assert found == {"title": "Big News", "author": "A B", "site": "Site", "published": "2020-01-01"}
    described = '<script type="application/ld+json">{"headline":"memory-safe language"}</script><title>Rust (language) - Wiki</title><h1>Rust (language)</h1>'
    assert about(described)["title"] == "Rust (language) - Wiki"
    assert about("<title>T</title><link rel=canonical href='/a/c'><meta name=author content='https://x.com/me'>") == {"title": "T", "canonical": "https://ex.com/a/c"}


def test_tables_of_contents_go():
    toc = "<ul><li><a href='#a'>A</a><li>2. <a href='#b'>B</a><ul><li><a href=#c>C</a></ul></ul>"
    heads = "<h2 id=a>A</h2><p>x</p><h2><a name=b></a>B</h2><h3><span id=c>C</span></h3><p>y</p>"
    assert [k for k, *_ in shown(toc + heads)] == ["heading", "paragraph", "heading", "heading", "paragraph"]
    assert [k for k, *_ in shown(toc.replace("#c", "#other") + heads)].count("item") == 3
    assert [k for k, *_ in shown(toc.replace("2. ", "See ") + heads)].count("item") == 3


def test_empty_sections(spark):
    rows = [("heading", 1, "T"), ("heading", 1, "gone"), ("heading", 2, "over"), ("heading", 3, "kept"), ("paragraph", 0, "x"), ("heading", 2, "gone"), ("heading", 3, "gone"),
            ("heading", 2, "last"), ("row", 1, "a"), ("heading", 2, "gone")]
    df = spark.createDataFrame([("k", n, *r) for n, r in enumerate(rows)] + [("e", 0, "heading", 2, "gone"), ("t", 0, "heading", 1, "T")], B.SCHEMA)
    left = B.without_empty_sections(df)
    assert left.filter("text = 'gone'").count() == 1 and left.count() == 8  # the second of level 1 has sections with content
    assert left.filter("key = 't'").count() == 1


def test_pages_are_parsed_once(spark, sf_dir):
    df = documents.page_markdown(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_assembly(spark):
    page = "<title>T</title><h1>T</h1><ol><li>a<li>b</ol><pre><code class=lang-sh>ls</code></pre><table><tr><th>x<th>y<tr><td>1</table>"
    twice = "<p>" + "a sentence that is long enough. " * 2 + "</p>"
    df = spark.createDataFrame([(1, "https://ex.com/a", page), (2, None, twice * 2 + "<p>end"), (3, None, None)], "page_id long, url string, html string")
    blocks = H.extract(df)
    out = {r["key"]: r for r in B.assemble(B.without_repeats(blocks)).collect()}
    assert out["1"]["markdown"] == "# T\n\n1. a\n2. b\n\n```sh\nls\n```\n\n| x | y |\n| --- | --- |\n| 1 |  |\n"
    assert out["2"]["markdown"].count("sentence") == 2 and set(out) == {"1", "2"}
    assert H.metadata(blocks).filter(F.col("key") == "1").first()["title"] == "T"


def test_closed_references(spark):
    """Where references must be closed, one that was cut short stays as it is."""
    page = "<html><head><title>A&amp;B &amp</title></head><body><p>x &amp; y&amp</p><p>&copy; &copy 1 &#65; &#65 &lt</p></body></html>"
    html = spark.createDataFrame([(page,)], "html string").select(H.closed_references("html")).first()[0]
    assert [(k, t) for k, _, t in H.page_blocks(html, None)] == [("title", "A&B &amp"), ("paragraph", "x & y&amp"), ("paragraph", "© &copy 1 A &#65 &lt")]


def test_repeats_in_other_letters(spark):
    """A block that repeats the one before it goes, whether one of them is set in bold or ends in a break."""
    said = "A sentence of at least thirty letters *** here"
    rows = [("paragraph", said), ("paragraph", f"**{said}  \n**"), ("paragraph", said), ("heading", said), ("paragraph", f"*{said}*"), ("paragraph", f"**{said}** more"), ("paragraph", said), ("paragraph", "**short**"), ("paragraph", "short")]
    blocks = spark.createDataFrame([("k", n, kind, 0, text) for n, (kind, text) in enumerate(rows)], B.SCHEMA)
    assert [r["pos"] for r in B.without_repeats(blocks).orderBy("pos").collect()] == [0, 3, 4, 5, 6, 7, 8]


def test_title_that_ends_in_the_name_of_its_site():
    """The site's name goes from a title however often, or once at its end."""
    page = '<title>Of | A | of | of</title><meta property="og:site_name" content="of"><p>x</p>'
    title = lambda often: next(t for k, _, t in H._parsed(page, None, often).about() if k == "title")
    assert title(True) == "Of | A" and title(False) == "Of | A | of"


def test_pages_leave_in_small_batches(spark, monkeypatch):
    """A worker gets few pages at a time, and holds few elements before they leave: what it holds does not grow with the table."""
    import pyarrow as pa

    setting, taken = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    class Pages:
        def mapInArrow(self, go, schema):
            taken.append(go)

    spark.conf.set(setting, 10000)
    pages = spark.createDataFrame([("a", "<p>x</p>", None)], "page_id string, html string, url string")
    with monkeypatch.context() as m:
        m.setattr(B, "dealt", lambda df: B.small_batches(df) and Pages())
        H.elements(pages)
    assert int(spark.conf.get(setting)) <= 1000
    html = ["<p>text</p>" * 20] * 900
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(900)]), pa.array(html), pa.array([None] * 900, pa.string())], names=["key", "html", "url"])
    sizes = [b.num_rows for b in taken[0](iter([batch]))]
    assert sum(sizes) == 900 * 21 and max(sizes) < H.ELEMENTS + 21


def test_tables_travel_in_small_batches(spark, sf_dir):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for query in (documents.documents_markdown, documents.protected_literals, documents.footnotes, documents.page_quality):
        spark.conf.set(setting, 10000)
        query(spark, sf_dir)
        assert int(spark.conf.get(setting)) <= 1000
