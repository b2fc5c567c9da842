"""Reply trees against plain recursion, and quoted history."""

import random

from pyspark.sql import functions as F

from quillflow.operators import threads as T


def brute_parents(items):
    """(thread, pos, indent) to the parent's position."""
    out = {}
    for t, p, d in items:
        before = [q for u, q, e in items if u == t and q < p and min(e, T.DEEPEST) < min(d, T.DEEPEST)]
        out[t, p] = max(before, default=None)
    return out


def brute_trees(items):
    """(thread, pos, parent) to depth, root, number and answers below."""
    own = {(t, p): u for t, p, u in items}
    up = {(t, p): u if u is not None and u < p and (t, u) in own else None for (t, p), u in own.items()}
    path = {}
    for t, p in sorted(own, key=lambda x: (str(x[0]), x[1])):
        path[t, p] = (path[t, up[t, p]] if up[t, p] is not None else ()) + (p,)
    out = {}
    for t in {k[0] for k in own}:
        for n, (k, way) in enumerate(sorted(((k, w) for k, w in path.items() if k[0] == t), key=lambda x: x[1]), 1):
            out[k] = (len(way) - 1, way[0], n, sum(k[1] in w[:-1] for j, w in path.items() if j[0] == t))
    return out


def test_parents_by_indent(spark):
    rng = random.Random(4)
    items = [(t, p, rng.choice([0, 0, 1, 1, 2, 3, 5, 80])) for t in ("a", "b", "c") for p in range(60)] + [("one", 1, 3), ("chain", 0, 0), *[("chain", k, k) for k in range(1, 70)]]
    df = spark.createDataFrame(items, "t string, p int, d int").withColumn("_level", F.lit("clash"))
    found = {(r["t"], r["p"]): r["parent_pos"] for r in T.with_parents(df, "t", "p", "d").collect()}
    assert found == brute_parents(items)
    odd = spark.createDataFrame([("a", 1, None), (None, 1, 0), (None, 2, 1), ("a", None, 1)], "t string, p int, d int")
    assert sorted(((r["t"], r["p"], r["parent_pos"]) for r in T.with_parents(odd, "t", "p", "d").collect()), key=str) == [("a", 1, None), ("a", None, None), (None, 1, None), (None, 2, 1)]
    assert T.with_parents(odd.limit(0), "t", "p", "d").count() == 0


def test_trees(spark):
    rng = random.Random(9)
    items = [(t, p, rng.choice([None, *range(p + 3)])) for t in ("a", "b", None) for p in range(50)] + [("deep", k, k - 1 if k else None) for k in range(40)]
    out = T.trees(spark.createDataFrame(items, "t string, p int, u int"), "t", "p", "u")
    assert {(r["t"], r["p"]): (r["depth"], r["root"], r["number"], r["n_below"]) for r in out.collect()} == brute_trees(items)
    assert T.trees(out.select("t", "p", "u").limit(0), "t", "p", "u").count() == 0


def test_quotes(spark):
    df = spark.createDataFrame([("a\nb", 0), ("a\nb", 2), (None, 1)], "x string, d int")
    assert [r[0] for r in df.select(T.quoted(F.col("x"), F.col("d"))).collect()] == ["a\nb", "> > a\n> > b", None]


def test_history(spark):
    cases = {
        "Yes.\n\nOn Mon, May 4, 2020 at 10:00 Ann wrote:\n> Shall we?\n> > Maybe\n": "Yes.",
        "> Shall we?\n\nYes, at noon.": "> Shall we?\n\nYes, at noon.",
        "Fine\n-----Original Message-----\nFrom: Ann\nText": "Fine",
        "Ja\nAm 4. Mai 2020 um 10 Uhr schrieb Ann:\n> So?": "Ja",
        "> only this": "> only this",
        "On the whole he wrote:\nnothing": "On the whole he wrote:\nnothing",
        "plain": "plain", "": "", "a\r\n\r\n> b\r\n": "a",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "x string")
    assert [r[0] for r in df.select(T.without_history(F.col("x"))).collect()] == [*cases.values(), None]


def test_discussion(spark):
    row = lambda indent, user, text: f"<tr class='athing comtr'><td><table><tr><td class=ind indent={indent}><img width={40 * indent}></td><td><a class=hnuser>{user}</a> <span class=age title='2020-01-0{indent + 1}T10:00:00 1'><a>1 hour ago</a></span><div class=comment><div class='commtext c00'>{text}</div><div class=reply><a>reply</a></div></div></td></tr></table></td></tr>"
    page = "<table>" + row(0, "ann", "First<p>more <i>x</i>") + row(1, "bob", "Answer") + row(2, "cy", "Deep") + row(0, "dee", "Second") + row(1, "eve", "") + "</table>"
    from quillflow.sources import discussions as D

    df = spark.createDataFrame([("p", page, None), ("q", "<p>no thread</p>", None), ("n", None, None)], "page_id string, html string, url string")
    found = D.replies(df)
    assert [(r["pos"], r["indent"], r["author"], r["markdown"]) for r in found.orderBy("pos").collect()] == [(0, 0, "ann", "First\n\nmore *x*"), (1, 1, "bob", "Answer"), (2, 2, "cy", "Deep"), (3, 0, "dee", "Second"), (4, 1, "eve", "")]
    (out,) = D.discussion(found).collect()
    assert out["markdown"] == "**ann** · 2020-01-01T10:00:00\n\nFirst\n\nmore *x*\n\n> **bob** · 2020-01-02T10:00:00\n> \n> Answer\n>\n> > **cy** · 2020-01-03T10:00:00\n> > \n> > Deep\n\n**dee** · 2020-01-01T10:00:00\n\nSecond\n"


def test_saved_mail():
    from quillflow.sources import html as H

    page = "<div class=a3s><p>Yes.</p><div class=gmail_quote><div class=gmail_attr>On Monday Ann wrote:</div><blockquote><p>Shall we?</p></blockquote></div></div><blockquote><p>kept</p></blockquote>"
    assert [t for k, _, t in H.page_blocks(page, None)] == ["Yes.", "kept"]
    page = "<div class=a3s><p>Fine.</p><div id=divRplyFwdMsg>From: Ann</div><p>old</p></div><div class=a3s><p>new</p><blockquote type=cite>old</blockquote></div>"
    assert [t for k, _, t in H.page_blocks(page, None)] == ["Fine.", "new"]
