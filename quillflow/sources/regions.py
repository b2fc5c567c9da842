"""Which part of a page is its article, and what beside and within it is furniture, decided over a table of elements.

A page's elements are numbered in document order; an element is the interval from its own number, `at`, to that of its last
descendant, `last`, with what it holds itself (characters, words, links, pictures ...). What a subtree holds is found by
events: every interval gives its beginning and its end, a running sum goes over all events of a page in order, and the sum at
the end less that before the beginning is the subtree's. Whether an element stands in one of a kind is a running maximum: of
the ends of those that began before, one reaches as far as the element. So choosing the region, its body and the furniture is
a chain of windows over one order (key, at), linear in the page and all in one shuffle; Python only parses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .references import OUTSIDE

# Limits that the rules speak of, in words unless said otherwise.
BODY_WORDS, BODY_RUNS = 70, 2
AFTER_WORDS, AFTER_SHARE = 50, 3
LABEL, EYEBROW = 2, 4
LINKS, TAIL_WORDS = 2, 25
MARK_WORDS = 6
CARD_WORDS = 80
P_BONUS = 40

#: What a subtree holds, summed up; all of it outside chrome.
SUMS = "score apart words plain runs links heads titles linked_heads seen dates pictures authors keep".split()


def _page():
    return Window.partitionBy("key")


def _before(end: int = 0):
    """The rows of the page up to this one (0) or up to the one before (-1)."""
    return _page().orderBy("at").rowsBetween(Window.unboundedPreceding, end)


def _behind(end: int = 0):
    """The rows of the page from its end back to this one (0) or to the one behind it (-1)."""
    return _page().orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, end)


def _within(flag: Column, itself: bool = True) -> Column:
    """Whether an element stands in one with the flag, or is one itself."""
    return F.coalesce(F.max(F.when(flag, F.col("last"))).over(_before(0 if itself else -1)) >= F.col("at"), F.lit(False))


def _of(flag: Column, value: Column) -> Column:
    """value of the page's one element with the flag."""
    return F.max(F.when(flag, value)).over(_page())


def _any(*flags: Column) -> Column:
    return reduce(lambda x, y: x | y, [F.coalesce(f, F.lit(False)) for f in flags])


def measured(elements: DataFrame) -> DataFrame:
    """Elements with what their subtrees hold (s_...) outside chrome, and `gone`: whether they stand in chrome."""
    own = F.when(_within(F.col("neutral") == 1), 0).otherwise(F.col("chars") + F.when(F.col("tag") == "p", P_BONUS).otherwise(0))
    apart = F.when(_within((F.col("furniture") == 1) | (F.col("tag") == "a")), own).otherwise(0)
    e = elements.withColumns({"gone": _within(F.col("chrome") == 1), "score": own, "apart": apart})
    # ends of elements with the same last descendant stand behind it, whichever first: their sums are the same
    ends = F.array(F.struct(F.col("at").alias("ord"), F.lit(0).alias("side")), F.struct(F.col("last").alias("ord"), F.lit(1).alias("side")))
    ev = e.withColumn("blocks", F.col("blocks")).withColumn("e", F.explode(ends)).select("*", "e.ord", "e.side").drop("e")
    begins = F.col("side") == 0
    live = {c: F.when(begins & ~F.col("gone"), F.col(c)).otherwise(0) for c in SUMS}
    order = _page().orderBy("ord", "side").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("r", F.struct(*[F.sum(x).over(order).alias(c) for c, x in live.items()]))
    ev = ev.withColumn("end", F.lead("r").over(_page().orderBy("at", "side"))).filter(begins)
    sums = {f"s_{c}": F.col(f"end.{c}") - F.col(f"r.{c}") + F.when(F.col("gone"), 0).otherwise(F.col(c)) for c in SUMS}
    return ev.withColumns(sums).drop("r", "end", "ord", "side")


def chosen(e: DataFrame) -> DataFrame:
    """Adds the page's region: a, z (first and last element), whole (a README or an issue, which is kept as it is).

    The main element of the highest score, or the body, is the region to begin with; a README or complete issue within it is
    taken whole. Of content containers that stand in no other, the only one, or the only one that is no teaser of another
    page, is taken if it holds three fifths of what it and the text around it score; links, furniture and teasers are no such
    text."""
    live, kind, says = ~F.col("gone"), F.col("region"), F.col("s_score") > 0
    best = lambda flag: F.max(F.when(live & flag, F.struct("s_score", "at", "last", "s_apart"))).over(_page())
    place = F.struct("s_score", "at", "last", "s_apart")
    start = F.coalesce(best((kind == "main") & says), _of(F.col("tag") == "body", place), _of(F.col("at") == 0, place))
    e = e.withColumn("root", start)
    inside = (F.col("at") >= F.col("root.at")) & (F.col("last") <= F.col("root.last"))
    box = kind.isin("content", "whole") & inside
    e = e.withColumns({"taken": best((kind == "whole") & inside & says), "candidate": live & (kind == "content") & inside & says & ~_within(box, False)})
    teaser = F.col("s_linked_heads") > 0
    count = lambda flag: F.count_if(F.col("candidate") & flag).over(_page())
    e = e.withColumns({"n_all": count(F.lit(True)), "n_own": count(~teaser), "teasers": F.sum(F.when(F.col("candidate") & teaser, F.col("s_score"))).over(_page())})
    single = F.col("candidate") & ((F.col("n_all") == 1) | ((F.col("n_own") == 1) & ~teaser))
    around = F.greatest(F.col("root.s_score") - F.col("s_score"), F.lit(0))
    apart = F.greatest(F.col("root.s_apart") - F.col("s_apart"), F.lit(0)) + F.when(F.col("n_all") > 1, F.coalesce("teasers", F.lit(0))).otherwise(0)
    enough = F.col("s_score") * 5 >= (F.col("s_score") + F.greatest(around - apart, F.lit(0))) * 3
    e = e.withColumn("found", F.coalesce("taken", best(single & enough), "root"))
    e = e.withColumns({"a": F.col("found.at"), "z": F.col("found.last"), "whole": F.col("taken").isNotNull()})
    return e.drop("root", "taken", "candidate", "n_all", "n_own", "teasers", "found", "region", "neutral", "chars", "score", "apart", "s_score", "s_apart", "links", "heads", "linked_heads", "seen", "pictures", "authors", "keep")


def body_of(e: DataFrame) -> DataFrame:
    """Adds `inside` (of the region, outside chrome) and body: the innermost element that holds three fifths of the region's
    running text, if it reads as an article; null otherwise."""
    e = e.withColumns({"inside": ~F.col("gone") & (F.col("at") >= F.col("a")) & (F.col("at") <= F.col("z")), "all_plain": _of(F.col("at") == F.col("a"), F.col("s_plain"))})
    body = F.struct("at", "last", "tag", F.col("s_plain").alias("plain"), F.col("s_runs").alias("runs"), "own_at")
    e = e.withColumn("body", F.max(F.when(F.col("inside") & (F.col("s_plain") * 5 >= F.col("all_plain") * 3), body)).over(_page()))
    reads = (F.col("body.plain") >= BODY_WORDS) & (F.col("body.runs") >= BODY_RUNS) & ~F.col("whole")
    return e.withColumn("body", F.when(reads, F.col("body"))).drop("all_plain")


def _mark(label: Column) -> Column:
    """A reading time or a counter, and nothing else."""
    split = F.regexp_replace(F.regexp_replace(F.lower(label), "(?<=[0-9])(?=\\p{L})|(?<=\\p{L})(?=[0-9])", " "), "[^\\p{L}0-9.,]+", " ")
    flat = F.trim(F.regexp_replace(F.regexp_replace(split, "(?<![0-9])[.,]|[.,](?![0-9])", " "), " +", " "))
    minutes = "(?:min|mins|minute|minutes)"
    return flat.rlike(f"^(?:[0-9]{{1,3}} {minutes} read(?:ing)?|read(?:ing)? time [0-9]{{1,3}} {minutes})$|^[0-9][0-9.,]* (?:[km] )?(?:likes?|views?|shares?|comments?)$")


def furniture_of(e: DataFrame) -> DataFrame:
    """Adds `left_out`: elements beside and within the body that are furniture, none where no body reads as an article.

    Beside are the elements whose parent is on the way from the region to its body and that are not themselves."""
    at, last, plain, links = F.col("at"), F.col("last"), F.col("s_plain"), F.col("s_links")
    has, stays, seen = F.col("body").isNotNull() & F.col("inside"), F.col("s_keep") > 0, F.col("s_seen") > 0
    b, y = F.col("body.at"), F.col("body.last")
    e = e.withColumns({"path": has & (at <= b) & (last >= y), "in_body": has & (at > b) & (at <= y)})
    off = has & ~F.col("path") & ~F.col("in_body")
    way = F.when(F.col("path"), F.struct("depth", F.struct("tag", "class", (F.col("s_dates") > 0).alias("dated")).alias("post")))
    runs = lambda flag: F.max(F.when(flag & (F.col("own_no") >= 0), F.struct("own_no", "intro"))).over(_page())["intro"]
    text_of_body = F.col("in_body") | (has & (at == b))
    # rows of links after the body's last text: what its children are
    child = F.col("in_body") & (F.col("parent") == b)
    says = F.col("tag").isin("p", "ul", "ol", "dl", "blockquote")
    is_text = child & ((plain > LABEL) | (says & (plain > 0)) | stays | seen)
    is_title = child & ~is_text & (F.col("s_titles") > 0)
    prose = F.col("plain") > 0
    in_set = (F.col("featured") == 1) & F.col("in_body")
    e = e.withColumns({
        "beside": off & ~_within(off, False), "posts": F.collect_list(way).over(_page()), "introduced": F.coalesce(runs(text_of_body) == 1, F.lit(False)),
        "in_sentence": _within((F.col("sentence") == 1) & F.col("inside"), False), "h1": F.min(F.when(F.col("inside") & (F.col("tag") == "h1"), F.struct("at", "titles", "parent"))).over(_page()),
        "is_row": child & ~says & (links >= LINKS) & ~is_text & ~is_title, "last_text": F.greatest(F.max(F.when(is_text, last)).over(_page()), F.col("body.own_at")),
        "last_title": F.max(F.when(is_title, at)).over(_page()), "lede": F.coalesce(F.min(F.when(text_of_body & (F.col("runs") > 0), at)).over(_page()), b),
        "stamps": F.collect_list(F.when(has & F.col("stamp").isNotNull(), F.struct("at", "stamp"))).over(_page()), "set_in": in_set & ~_within(in_set, False), "in_set": _within(in_set),
    })
    free = F.col("in_body") & ~F.col("in_set") & prose
    again = F.exists("stamps", lambda x: (x["stamp"] == F.col("stamp")) & (x["at"] < at)) & (at < F.col("lede"))
    closed = F.coalesce(at > F.col("last_text"), F.lit(True)) & (F.col("last_title").isNull() | F.coalesce(F.col("last_text") > F.col("last_title"), F.lit(False)))
    kicker = (F.col("s_words") > 0) & (F.col("s_words") <= EYEBROW) & ~stays & (F.col("s_titles") == 0) & ~seen & F.col("label").isNotNull() & ~F.col("label").rlike("[0-9.?!:;,]")
    above = has & (F.col("h1.titles") == 1) & (F.col("parent") == F.col("h1.parent")) & (at < F.col("h1.at"))
    card = (F.col("s_authors") > 0) & (F.col("s_pictures") > 0) & (F.col("s_runs") > 0) & (F.col("s_words") <= CARD_WORDS) & (F.col("s_titles") == 0) & (F.col("s_dates") == 0)
    post = F.get(F.filter("posts", lambda w: w["depth"] == F.col("depth")), F.lit(0))["post"]
    same = (post["tag"] == F.col("tag")) & post["class"].eqNullSafe(F.col("class")) & (F.col("class").isNotNull() | (F.col("tag") == "article"))
    reply = F.coalesce(F.col("beside") & (at > y) & (F.col("s_dates") > 0) & (F.col("s_linked_heads") == 0) & (plain > 0) & post["dated"] & same, F.lit(False))
    after = F.col("beside") & (at > y) & ~stays
    next_ = F.min(F.when(F.col("beside") & (at > y), at)).over(_page())
    closing = (F.col("s_runs") > 0) & (links == 0) & ~seen
    row_spoken = F.when(text_of_body & (F.col("own_no") >= 0), F.struct("own_no", "intro"))
    e = e.withColumns({
        "card": has & card & ~stays & ~F.col("in_body") & ~F.col("path"), "first_prose": F.min(F.when(free, at)).over(_page()), "last_prose": F.max(F.when(free, at)).over(_page()),
        "date": F.when(F.col("dates") == 1, F.struct(again.alias("again"), F.col("s_words").alias("words"))), "trailing": F.col("is_row") & closed,
        "bad_kicker": F.max(F.when(above & ~kicker, at)).over(_page()), "above": above, "reply": reply, "after": after,
        "loose": after & ~reply & ~((at == next_) & (F.col("introduced") | closing)) & (F.col("furniture") == 0), "spoken": F.max(row_spoken).over(_before(-1)),
    })
    # the first date at or behind an element's beginning, the next card behind it, the words of all loose blocks, the first row
    e = e.withColumns({
        "date": F.last("date", ignorenulls=True).over(_behind()), "next_card": F.min(F.when(F.col("card"), at)).over(_behind(-1)),
        "loose_words": F.sum(F.when(F.col("loose"), plain)).over(_page()), "first_row": F.min(F.when(F.col("trailing"), at)).over(_page()),
    })
    few = (F.col("loose_words") < AFTER_WORDS) & (F.col("loose_words") * AFTER_SHARE < F.col("body.plain"))
    block = F.col("tag").isin("p", "div", "section", "header", "li", "ul", "ol", "figcaption")
    alone = has & ~F.col("path") & ~F.col("in_sentence") & ~stays & (F.col("s_titles") == 0) & ~seen & ((F.col("sentence") == 0) | (F.col("tag") == "p"))
    return e.withColumn("left_out", _any(
        F.col("beside") & (last < b) & (plain <= LABEL) & (F.col("s_heads") == 0) & ~seen & ~stays,  # banners and back links before the body
        F.col("after") & (F.col("furniture") == 1) & ~F.col("reply"), F.col("loose") & few,  # what stands after it
        F.col("above") & (at > F.coalesce("bad_kicker", F.lit(-1))),  # labels right above the title
        F.col("trailing") & F.col("body.tag").isin("article", "main", "section", "div", "body") & (F.col("body.runs") >= BODY_RUNS) & (F.col("body.plain") >= TAIL_WORDS)
        & ~((at == F.col("first_row")) & F.coalesce(F.col("spoken.intro") == 1, F.lit(False))),  # rows of links
        alone & F.col("s_words").between(1, MARK_WORDS) & _mark(F.col("label")),  # reading times and counters
        has & (F.col("trail") == 1) & (at < F.col("lede")) & ~F.col("in_sentence") & ~seen,  # trails
        has & ~F.col("path") & block & (F.col("s_dates") == 1) & F.col("date.again") & (F.col("date.words") == F.col("s_words")) & (at < F.col("lede")),  # dates said before
        F.col("card") & F.coalesce(F.col("next_card") > last, F.lit(True)),  # authors
        F.col("set_in") & (F.col("first_prose") < at) & (F.col("last_prose") > last),  # comments set into the text
    ))


def article(elements: DataFrame) -> DataFrame:
    """Blocks of every page's region without chrome and furniture: key, pos, kind, level, text."""
    e = furniture_of(body_of(chosen(measured(elements))))
    cut = F.when(F.col("left_out") | (F.col("chrome") == 1), F.struct("at", "last"))
    e = e.select("key", "blocks", "a", "z", F.collect_list(cut).over(_page()).alias("cuts")).filter("blocks is not null")
    one = e.select("key", F.explode("blocks").alias("b"), "a", "z", "cuts").select("key", "b.*", "a", "z", "cuts")
    aside = F.col("kind").isin("title", "meta", "warning", "error")
    gone = F.exists("cuts", lambda c: F.col("at").between(c["at"], c["last"]))
    shown = (F.col("kind") != "chrome") & F.col("at").between(F.col("a"), F.col("z")) & ~gone
    note = F.col("kind") == "note"  # one beside the article is still found by what refers to it
    level = F.when(note & ~shown, OUTSIDE).otherwise(F.col("level")).cast("int").alias("level")
    return one.filter(aside | note | shown).select("key", "pos", "kind", level, "text")


def summary(elements: DataFrame) -> DataFrame:
    """Of each page: the region's and the body's tags, the region's words, and how many of them were left out as furniture."""
    e = furniture_of(body_of(chosen(measured(elements))))
    e = e.withColumn("out", _within(F.col("left_out")))
    total = lambda flag: F.coalesce(F.sum(F.when(F.col("inside") & flag, F.col("words"))), F.lit(0)).cast("long")
    return e.groupBy("key").agg(F.max(F.when(F.col("at") == F.col("a"), F.col("tag"))).alias("region"), F.max("body.tag").alias("body"), total(F.lit(True)).alias("words"), total(F.col("out")).alias("left_out"))
