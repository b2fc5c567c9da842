"""Regions, bodies and furniture of hand-made pages."""

import pytest

from quillflow.sources import html as H, regions

PROSE = "<p>" + "word " * 30 + "end.</p>"
BIO = "Ann writes long books about very small things and lives in a town by the sea."
PAGES = {
    # name: (page, region, body, texts that must go, texts that must stay)
    "an article beside a menu": (f"<body><div>Buy this</div><article>{PROSE * 3}</article><div>Tail</div></body>", "article", "article", ["Buy this", "Tail"], []),
    "a long introduction keeps the page": (f"<body><p>{'intro ' * 200}</p><article>{PROSE}</article></body>", "body", None, [], ["intro"]),
    "links outside are no introduction": (f"<body><p>{'<a href=/x>some link text</a> ' * 90}</p><article>{PROSE}</article></body>", "article", None, ["some link"], []),
    "named rails outside are none": (f"<body><div class='site-comments'>{'they say ' * 90}</div><article>{PROSE}</article></body>", "article", None, ["they say"], []),
    "asides neither": (f"<body><aside>{'by the way ' * 90}</aside><article>{PROSE}</article></body>", "article", None, ["by the way"], []),
    "sibling articles keep their page": (f"<body><main><article>{PROSE}</article><article>{PROSE}</article></main></body>", "main", None, [], []),
    "but not teasers": (f"<body><main><article>{PROSE * 3}</article><article><h2><a href=/o>Other page</a></h2></article></main></body>", "article", "article", ["Other page"], []),
    "a readme is taken whole": (f"<body><main><div>Files</div><article class='markdown-body entry-content' itemprop=text>{PROSE}</article></main></body>", "article", None, ["Files"], []),
    "a content class": (f"<body><div>Site</div><div class=entry-content>{PROSE * 3}</div></body>", "div", "div", ["Site"], []),
    "main of the highest score": (f"<body><main><p>Short one</p></main><div role=main>{PROSE * 3}</div></body>", "div", "div", ["Short one"], []),
    "a back link before the body": (f"<body><main><div><a href=/>Home</a></div><h1>Title</h1><div>{PROSE * 3}</div></main></body>", "main", "div", ["Home"], ["Title"]),
    "a lede and a picture stay": (f"<body><main><div>What this is all about</div><div><img src=/a.png></div><div>{PROSE * 3}</div></main></body>", "main", "div", [], ["What this", "a.png"]),
    "few words after the body": (f"<body><main><div>{PROSE * 3}</div><div>Sign up for our letter now</div></main></body>", "main", "div", ["Sign up"], []),
    "many words stay": (f"<body><main><div>{PROSE * 5}</div><div>{'<a href=/l>more to say here</a> and so on ' * 30}</div></main></body>", "main", "div", [], ["more to say"]),
    "named furniture goes however long": (f"<body><main><div>{PROSE * 5}</div><div class=share-bar>{'<b>share</b> this now ' * 20}</div></main></body>", "main", "div", ["share"], []),
    "sources stay": (f"<body><main><div>{PROSE * 3}</div><div><h2>References</h2><span>A book</span></div></main></body>", "main", "div", [], ["A book"]),
    "code stays": (f"<body><main><div>{PROSE * 3}</div><div><pre>x = 1</pre></div></main></body>", "main", "div", [], ["x = 1"]),
    "a conclusion of prose stays": (f"<body><main><div>{PROSE * 3}</div><div><p>So in the end all of this shows that things are as we said they are.</p></div></main></body>", "main", "div", [], ["So in the end"]),
    "what the body introduces stays": (f"<body><main><div>{PROSE * 3}<p>These are the parts of it:</p></div><div>One two</div></main></body>", "main", "div", [], ["One two"]),
    "a label above the title": (f"<body><article><div>News</div><h1>Title</h1>{PROSE * 3}</article></body>", "article", "article", ["News"], ["Title"]),
    "a date above the title stays": (f"<body><article><div>May 2020</div><h1>Title</h1>{PROSE * 3}</article></body>", "article", "article", [], ["May 2020"]),
    "reading times and counters": (f"<body><article><h1>Title</h1><div>8 min read</div><span>1.2K views</span>{PROSE * 3}</article></body>", "article", "article", ["min read", "views"], []),
    "but not in a sentence": (f"<body><article><ul><li>8 min read</li><li>Some other fact</li></ul><p>It has 9 likes now.</p>{PROSE * 3}</article></body>", "article", "article", [], ["8 min read", "9 likes"]),
    "tags under the text": (f"<body><article>{PROSE * 3}<div><a href=/a>one</a> <a href=/b>two</a></div></article></body>", "article", "article", ["one"], []),
    "links under a heading stay": (f"<body><article>{PROSE * 3}<h2>See also</h2><div><a href=/a>one</a> <a href=/b>two</a></div></article></body>", "article", "article", [], ["one"]),
    "links that a sentence introduces stay": (f"<body><article>{PROSE * 3}<p>Here are links that you may want:</p><div><a href=/a>one</a> <a href=/b>two</a></div></article></body>", "article", "article", [], ["one"]),
    "a trail": (f"<body><main><ol><li><a href=/>Start</a></li><li><a href=/b>Blog</a></li><li>My page</li></ol><div><h1>Title</h1>{PROSE * 3}</div></main></body>", "main", "div", ["Start", "My page"], ["Title"]),
    "a date said before": (f"<body><article><div><time datetime=2020-01-02>2 Jan</time></div><div><time datetime=2020-01-02>January 2</time></div>{PROSE * 3}</article></body>", "article", "article", ["January 2"], ["2 Jan"]),
    "an author's card": (f"<body><main><div>{PROSE * 3}</div><div><p>{BIO}</p><img src=/me.png><a rel=author href=/me>Ann</a></div></main></body>", "main", "div", ["small things"], []),
    "a comment set into the text": (f"<body><article>{PROSE * 2}<div class=top-comment><p>I like it.</p></div>{PROSE}</article></body>", "article", "article", ["I like it"], []),
    "a comment at the end stays": (f"<body><article>{PROSE * 3}<div class=topComment><p>I like it.</p></div></article></body>", "article", "article", [], ["I like it"]),
    "replies stay": (
        f"<body><main><article class=post><time datetime=2020-01-01>1 Jan</time>{PROSE * 3}</article><article class=post><time datetime=2020-01-02>2 Jan</time><p>I agree.</p></article></main></body>",
        "main", "article", [], ["I agree"],
    ),
    "a banner goes": (f"<body><header><a href=/>Site name</a></header><main>{PROSE * 3}</main></body>", "main", "main", ["Site name"], []),
    "a title in the banner stays": (f"<body><header><h1>Real title</h1></header>{PROSE * 3}</body>", "body", "body", [], ["Real title"]),
    "chrome by complete names only": (f"<body><div class=related-posts>Related one</div><div class=related-postsx>Other one here</div>{PROSE * 3}</body>", "body", "body", ["Related one"], ["Other one here"]),
    "no article, nothing goes": ("<body><div><a href=/>Home</a></div><p>Few words.</p><div>8 min read</div></body>", "body", None, [], ["Home", "8 min read"]),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, "https://ex.com/a", page) for name, (page, *_) in PAGES.items()]
    rows += [("empty", None, ""), ("null", None, None), ("text", None, "just text"), ("odd", None, "<p><<b>x</p></nope><table><tr>")]
    elements = H.elements(spark.createDataFrame(rows, "page_id string, url string, html string")).cache()
    out = {r["key"]: (r["region"], r["body"], r["words"], r["left_out"]) for r in regions.summary(elements).collect()}
    texts = {}
    for r in regions.article(elements).orderBy("key", "pos").collect():
        texts.setdefault(r["key"], []).append(r["text"])
    return out, {k: "\n".join(v) for k, v in texts.items()}


@pytest.mark.parametrize("name", PAGES)
def test_page(found, name):
    _, region, body, gone, stay = PAGES[name]
    summary, texts = found
    assert summary[name][:2] == (region, body)
    assert [x for x in gone if x in texts[name]] == [] == [x for x in stay if x not in texts[name]]
    assert "word word" in texts.get(name, "") or "Few words" in texts[name]


def test_odd_pages(found):
    summary, texts = found
    assert summary["empty"] == ("#page", None, 0, 0) and "null" not in summary and texts["text"] == "just text" and "x" in texts["odd"]


def test_subtree_sums(spark):
    page = "<body><div><p>one two</p><div><p>three</p><nav><p>menu</p></nav></div></div><p>four</p></body>"
    e = regions.measured(H.elements(spark.createDataFrame([("k", None, page)], "page_id string, url string, html string")))
    sums = {r["at"]: (r["tag"], r["last"], r["s_words"], r["gone"]) for r in e.collect()}
    assert sums == {
        0: ("#page", 8, 4, False), 1: ("body", 8, 4, False), 2: ("div", 7, 3, False), 3: ("p", 3, 2, False), 4: ("div", 7, 1, False), 5: ("p", 5, 1, False),
        6: ("nav", 7, 0, True), 7: ("p", 7, 0, True), 8: ("p", 8, 1, False),
    }
