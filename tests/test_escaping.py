"""Escaped text reads back as itself: a small reader of CommonMark's inline rules against generated paragraphs."""

import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillflow.functions import escaping as E

PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TAGS = {"strong", "em", "del"}


def is_punct(c):
    return c in PUNCT or unicodedata.category(c)[0] in "PS"


def flanks(before, after, mark):
    left = not after.isspace() and (not is_punct(after) or before.isspace() or is_punct(before))
    right = not before.isspace() and (not is_punct(before) or after.isspace() or is_punct(after))
    if mark == "_":
        return left and (not right or is_punct(before)), right and (not left or is_punct(after))
    return left, right


def crossed(label, rest):
    """Whether code begins in a label and ends behind it: code binds tighter than links."""
    lengths = {len(x) for x in re.findall("`+", rest)}
    inner = [len(x) for x in re.findall(r"\\.|`+", label) if x[0] == "`"]
    return any(n in lengths and inner[k + 1 :].count(n) % 2 == 0 and n not in inner[k + 1 :] for k, n in enumerate(inner))


def read(text):
    """(character, styles) of a line of inline Markdown: escapes, references, code, tags, links, then the delimiter stack."""
    nodes, at, tags = [], 0, []  # nodes: [text, styles] or delimiter runs [text, styles, mark, opens, closes]
    while at < len(text):
        c = text[at]
        if c == "\\" and at + 1 < len(text) and text[at + 1] in PUNCT:
            nodes.append([text[at + 1], set(tags)])
            at += 2
        elif c == "&" and (m := re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});").match(text, at)) and html.unescape(m[0]) != m[0]:
            nodes.append([html.unescape(m[0]), set(tags)])
            at = m.end()
        elif c == "`":
            run = re.compile("`+").match(text, at)[0]
            end = next((m.start() for m in re.finditer("`+", text[at + len(run) :]) if len(m[0]) == len(run)), None)
            if end is None:
                nodes.append([run, set(tags)])
                at += len(run)
            else:
                body = text[at + len(run) : at + len(run) + end]
                body = body[1:-1] if body[:1] == body[-1:] == " " and body.strip() else body
                nodes += [[x, {*tags, "code"}] for x in body]
                at += 2 * len(run) + end
        elif c == "<" and (m := re.compile(r"<(/?)([a-z]+)>|<[A-Za-z/!?][^>]*>").match(text, at)):
            if m[2] in TAGS:
                tags.remove(m[2]) if m[1] else tags.append(m[2])
            else:
                nodes.append(["\0html", set()])
            at = m.end()
        elif c in "*_~":
            run = re.compile(re.escape(c) + "+").match(text, at)[0]
            opens, closes = flanks(text[at - 1] if at else " ", text[at + len(run)] if at + len(run) < len(text) else " ", c)
            nodes.append([run, set(tags), c, opens, closes] if c != "~" or len(run) <= 2 else [run, set(tags)])
            at += len(run)
        elif c == "[" and (m := re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]\((?:<[^<>]*>|[^\s()]*)\)").match(text, at)) and not crossed(m[1], text[m.end(1) :]):
            nodes += [[x, s | set(tags) | {"link"}] for x, s in read(m[1])]
            at = m.end()
        elif text.startswith("[^", at):
            nodes.append(["\0note", set()])
            at += 2
        else:
            nodes.append([c, set(tags)])
            at += 1
    k = 0
    while k < len(nodes):
        own = nodes[k]
        if len(own) == 5 and own[4]:
            j = k - 1
            while j >= 0:
                other = nodes[j]
                odd = len(other) == 5 and (own[3] or other[4]) and (len(own[0]) + len(other[0])) % 3 == 0 and not (len(own[0]) % 3 == 0 and len(other[0]) % 3 == 0)
                if len(other) == 5 and other[2] == own[2] and other[3] and other[0] and not (own[2] != "~" and odd) and (own[2] != "~" or len(other[0]) == len(own[0])):
                    break
                j -= 1
            if j >= 0:
                n = 2 if len(own[0]) >= 2 and len(nodes[j][0]) >= 2 else 1
                style = "del" if own[2] == "~" else "strong" if n == 2 else "em"
                for x in nodes[j + 1 : k]:
                    x[1].add(style)
                    if len(x) == 5:
                        del x[2:]
                own[0], nodes[j][0] = own[0][n:], nodes[j][0][n:]
                if own[0]:
                    continue
        k += 1
    return [(c, frozenset(x[1])) for x in nodes for c in x[0]]


def starts_block(line, after_line):
    line = line.strip()
    return bool(
        re.match(r"#{1,6}(\s|$)|>|```|~~~|[-+*](\s|$)|[0-9]{1,9}[.)](\s|$)|<[A-Za-z/!?]|\[[^\]]+\]:", line) or re.fullmatch(r"([-*_])(\s*\1){2,}", line)
        or (after_line and re.fullmatch(r"=+|-+|[-:|][-:| ]*-[-:| ]*", line))
    )


ALPHABET = list("**__~~``\\<>&[]()!#-+=|:.^ ab1é") + ["**", "~~", "&amp;", "[^1]", "](", "<b>", "![", "a ", " b", "“", "***", "1. ", "- "]


@pytest.mark.parametrize("seed", range(4))
def test_plain_text(seed):
    rng = random.Random(seed)
    for _ in range(8000):
        lines = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 14))).strip() for _ in range(rng.choice([1, 1, 2]))]
        text = "\n".join(x for x in lines if x)
        out = E.escaped(text)
        for n, line in enumerate(out.split("\n")):
            assert not starts_block(line, n), (text, out)
        assert "".join(c for c, _ in read(out)) == text, (text, out)
        assert all(not s for _, s in read(out)), (text, out)


@pytest.mark.parametrize("seed", range(4))
def test_styled_runs(seed):
    rng = random.Random(seed)
    for _ in range(8000):
        runs = []
        for _ in range(rng.randint(1, 5)):
            text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 6)))
            styles = frozenset(rng.sample(["strong", "em", "del"], rng.choice([0, 0, 1, 1, 2]))) if rng.random() < 0.85 else frozenset(["code"])
            runs.append((text.replace("`", "") if "code" in styles else text, styles, "https://ex.com/a" if rng.random() < 0.15 and "code" not in styles else ""))
        runs = [("a", frozenset(), ""), *runs, ("b", frozenset(), "")]  # the edges of lines are tested above
        want = [(c, s | ({"link"} if to else frozenset())) for t, s, to in E._tidy(runs) for c in t]
        out = E.styled(runs)
        assert [(c, s) for c, s in read(out)] == want, (runs, out)


def test_what_stays_as_it_is():
    for text in ("snake_case", "[!tip]", "C:\\Users", "5 * 3", "________"[:2] + "a", "a < b", "AT&T", "x [1] y", "2 ~ 3", "it's 50% off!"):
        assert E.escaped(text) == text
    assert E.escaped("*a*") == "\\*a\\*" and E.escaped("1. x") == "1\\. x" and E.escaped("# x") == "\\# x" and E.escaped("---") == "\\-\\-\\-"
    assert E.escaped("Issue #", "heading") == "Issue \\#" and E.escaped("a|b\nc", "cell") == "a\\|b<br>c" and E.escaped("a[b]", "label") == "a\\[b\\]"
    assert E.styled([("Hello ", frozenset(["strong"]), ""), ("world", frozenset(), "")]) == "**Hello** world"
    assert E.styled([("x", frozenset(["code"]), ""), (" y", frozenset(["em"]), "")]) == "`x` *y*"
    assert E.styled([("see ", frozenset(), ""), ("[this]", frozenset(), "http://x.y/a b")]) == "see [\\[this\\]](<http://x.y/a b>)"


def test_column(spark):
    df = spark.createDataFrame([("*a*",), ("plain",), (None,), ("",), ("- x",)], "t string")
    assert [r[0] for r in df.select(E.escaped_text(F.col("t"))).collect()] == ["\\*a\\*", "plain", None, "", "\\- x"]


def test_long_lines_of_marks_take_linear_time():
    """A line with very many runs that pair with none is judged by its first opener and last closer, not run by run."""
    import time

    took = []
    for n in (4_000, 40_000):
        text = "a *b " * n
        began = time.process_time()
        assert E.escaped(text) == text
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0] + 0.5
