"""Markdown as tokens: what is verbatim, and every place that names another file.

Forms of targets: `inline` (links and images), `definition` (`[label]: target`), `wiki` (`[[target]]`), `attribute`, `srcset`
and `css` (within tags and style elements of HTML); `comment` is a comment. Code (fenced, inline, `pre`, `code`, `script`),
math and front matter are verbatim, whatever they hold. The tokens of a text joined are the text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Attributes that hold one address.
ADDRESSES = "src|href|poster|data|data-src|background|cite|longdesc"
_SPAN = re.compile(
    r"(?P<front>\A---[ \t]*\n.*?^(?:---|\.\.\.)[ \t]*(?:\n|\Z))"
    r"|(?P<fence>^ {0,3}(?P<mark>`{3,}|~{3,})[^\n]*(?:\n(?:.*?^ {0,3}(?P=mark)[`~]*[ \t]*$|.*\Z)|\Z))"
    r"|(?P<definition>^ {0,3}\[(?!\^)(?:[^\[\]\\\n]|\\.)+\]:[ \t]*(?P<of>(?:<[^<>\n]*>|[^\s<]\S*)))"
    r"|(?P<escape>\\[!-/:-@\[-`{-~])"
    r"|(?P<code>(?<!`)(?P<ticks>`+)(?!`)(?:(?!\n[ \t]*\n).)*?(?<!`)(?P=ticks)(?!`))"
    r"|(?P<math>\$\$.+?\$\$|(?<![\\$\w])\$(?=\S)[^$\n]*?(?<=\S)\$(?![\w$]))"
    r"|(?P<comment><!--.*?-->)"
    r"|(?P<raw><(?P<el>pre|code|script|textarea)\b[^>]*>.*?</(?P=el)\s*>)"
    r"|(?P<style><style\b[^>]*>)(?P<sheet>.*?)(?P<end></style\s*>)"
    r"|(?P<tag><[A-Za-z][\w:-]*(?:\s+[^\s=>\"'/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*\s*/?>)"
    r"|(?P<wiki>!?\[\[)(?P<page>[^\[\]|#\n]+)(?=[#|\]])"
    r"|(?P<inline>\]\([ \t]*\n?[ \t]*)(?P<to><[^<>\n]*>|(?:[^\s()<\\]|\\.|\((?:[^\s()\\]|\\.)*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?=[ \t\n]*(?:\)|[ \t\n][\"'(]))"
    r"|(?P<open>\[)|(?P<close>\])|(?P<blank>\n[ \t]*(?=\n))",
    re.M | re.S | re.I,
)
_ATTRIBUTE = re.compile(rf"(?<=[\s\"'])(?P<name>{ADDRESSES}|srcset|style)\s*=\s*(?:\"(?P<d>[^\"]*)\"|'(?P<s>[^']*)'|(?P<b>[^\s>\"']+))", re.I)
_CANDIDATE = re.compile(r"(?:^|,)\s*(?P<url>[^\s,]\S*?[^\s,]|[^\s,])(?=\s|,\s|,?\Z)")
_CSS = re.compile(r"(?P<comment>/\*.*?\*/)|(?P<open>url\(\s*[\"']?)(?P<url>[^\"')]*?)(?=[\"']?\s*\))|(?P<import>@import\s+[\"'])(?P<sheet>[^\"']*)", re.S | re.I)


def tokens(text: str) -> list[tuple[str, str]]:
    """(form, text) pairs; form is empty for what is verbatim."""
    out: list[tuple[str, str]] = []
    done = 0

    def keep(upto: int) -> None:
        nonlocal done
        if upto > done:
            if out and not out[-1][0]:
                out[-1] = ("", out[-1][1] + text[done:upto])
            else:
                out.append(("", text[done:upto]))
            done = upto

    def take(form: str, span: tuple[int, int]) -> None:
        nonlocal done
        keep(span[0])
        if span[1] > span[0]:
            out.append((form, text[span[0] : span[1]]))
            done = span[1]

    def sheet(a: int, b: int, form: str = "css") -> None:
        for c in _CSS.finditer(text, a, b):
            if not c["comment"]:
                take(form, c.span("url") if c["open"] else c.span("sheet"))

    at = depth = 0  # open brackets of the paragraph
    while m := _SPAN.search(text, at):
        at = max(m.end(), m.start() + 1)
        if m["open"]:
            depth += 1
        elif m["blank"]:
            depth = 0
        elif m["close"] or m["inline"]:
            if m["inline"] and depth:
                take("inline", m.span("to"))
            depth = max(depth - 1, 0)
        elif m["definition"]:
            take("definition", m.span("of"))
        elif m["wiki"]:
            take("wiki", m.span("page"))
        elif m["comment"]:
            take("comment", m.span())
        elif m["style"]:
            sheet(*m.span("sheet"))
        elif m["tag"]:
            for a in _ATTRIBUTE.finditer(text, *m.span()):
                group = next(g for g in "dsb" if a[g] is not None)
                if a["name"].lower() == "style":
                    sheet(*a.span(group), form="css")
                elif a["name"].lower() == "srcset":
                    for c in _CANDIDATE.finditer(a[group]):
                        take("srcset", tuple(a.start(group) + k for k in c.span("url")))
                else:
                    take("attribute", a.span(group))
    keep(len(text))
    return out or [("", "")]


TOKEN = T.StructType().add("form", T.StringType()).add("text", T.StringType())


@F.pandas_udf(T.ArrayType(TOKEN))
def tokens_of(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else [{"form": f, "text": t} for f, t in tokens(x)])


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda t: t["text"]), "")


def path_of(form: Column, target: Column) -> Column:
    """The path that a target names: without angle brackets, escapes, query and fragment."""
    bare = F.when(form.isin("inline", "definition"), F.regexp_replace(F.regexp_replace(target, "^<(.*)>$", "$1"), "\\\\([!-/:-@\\[-`{-~])", "$1")).otherwise(target)
    bare = F.when(form.isin("attribute", "srcset"), F.replace(F.replace(F.replace(bare, F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))).otherwise(bare)
    path = F.when(form == "wiki", F.trim(bare)).otherwise(F.regexp_replace(bare, "[?#].*$", ""))
    return F.regexp_replace(F.coalesce(F.when(form == "wiki", path).otherwise(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))), path), "^(?:\\./)+", "")


def written(form: Column, target: Column, path: Column) -> Column:
    """`path` in the place of `target`, spelt as its form needs, with the query and fragment that the target has."""
    more = F.when(form == "wiki", "").otherwise(F.regexp_extract(F.regexp_replace(target, ">$", ""), "([?#].*)$", 1))
    text = F.when(form == "wiki", path).otherwise(F.replace(F.replace(F.replace(F.replace(F.replace(path, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")), F.lit('"'), F.lit("%22")), F.lit("?"), F.lit("%3F")), F.lit("#"), F.lit("%23")))
    text = F.when(form.isin("inline", "definition"), F.regexp_replace(text, "[()<>\\\\]", "\\\\$0")).when(form.isin("css", "srcset"), F.replace(F.replace(F.replace(F.replace(text, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29")), F.lit("'"), F.lit("%27")), F.lit(","), F.lit("%2C"))).otherwise(text)
    text = F.when(form.isin("attribute", "srcset"), F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;"))).otherwise(text)
    angle = form.isin("inline", "definition") & target.startswith("<")
    return F.when(angle, F.concat(F.lit("<"), text, more, F.lit(">"))).otherwise(F.concat(text, more))
