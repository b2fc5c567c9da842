"""Markdown clean-up, literal protection and chunking. Small Arrow-batched helpers where a fence must stay untouched."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

LITERAL = re.compile(
    r"(?P<fence>^(?P<mark>`{3,}|~{3,})[^\n]*\n.*?^(?P=mark)[`~]*[ \t]*$)|(?P<math>\$\$.+?\$\$)|(?P<code>(?P<tick>`+)(?!`).+?(?<!`)(?P=tick)(?!`))"
    r"|(?P<image>!?\[[^\]\n]*\]\([^)\s]+(?:\s+\"[^\"]*\")?\))|(?P<url><?https?://[^\s<>)]+>?)|(?P<tag></?[A-Za-z][^<>\n]*>|<!--.*?-->)",
    re.M | re.S,
)
TOKEN = "⟦{}⟧"


def protect(text: str) -> tuple[str, list[str]]:
    """Text with its literals (fences, math, code, links, addresses, tags) replaced by numbered tokens, and the literals.

    Texts that hold a token's brackets already are protected as one literal."""
    if "⟦" in text:
        return TOKEN.format(0), [text]
    found: list[str] = []

    def keep(m):
        found.append(m[0])
        return TOKEN.format(len(found) - 1)

    return LITERAL.sub(keep, text), found


def restore(text: str, literals: list[str]) -> str:
    return re.sub("⟦(\\d+)⟧", lambda m: literals[int(m[1])] if int(m[1]) < len(literals) else m[0], text)


def split_chunks(text: str, limit: int = 32_000) -> list[str]:
    """Pieces of at most `limit` characters whose concatenation is the text; cut after the last blank line, else the last
    newline, else anywhere but within a token."""
    out = []
    while len(text) > limit:
        at = text.rfind("\n\n", 1, limit - 1) + 2
        if at < 3:
            at = text.rfind("\n", 1, limit) + 1
        if at < 2:
            at = limit
            left = text.rfind("⟦", max(0, at - 16), at)
            if left > 0 and "⟧" not in text[left:at]:
                at = left
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


def clean(text: str) -> str:
    """Normal form: no trailing blanks but two-space breaks within a paragraph, headings apart, at most one blank line,
    labels of links on one line, one final newline. Fences stay as they are, and cleaning twice changes nothing."""
    out: list[str] = []
    fence = None
    text = re.sub(r"\[([^\[\]`\n]+)\n\s*\n[^\[\]`]*?\]\((\S+?)\)", r"[\1](\2)", text.replace("\r\n", "\n")) if "```" not in text and "~~~" not in text else text.replace("\r\n", "\n")
    for line in text.split("\n"):
        mark = re.match(r"^ {0,3}(`{3,}|~{3,})", line)
        if fence is not None:
            out.append(line)
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and line.strip() == mark[1]:
                fence = None
            continue
        if mark:
            fence = mark[1]
            out.append(line)
            continue
        body = line.rstrip(" \t")
        heading = re.match(r"^#{1,6} ", body)
        if not body and (not out or not out[-1]):
            continue
        if out and out[-1] and (heading or re.match(r"^#{1,6} ", out[-1])) and body and not _fenced(out):
            out.append("")
        out.append(body + "  " if body and line.endswith("  ") and not heading else body)
        if not body and len(out) > 1:
            out[-2] = out[-2].rstrip()
    while out and not out[-1].strip():
        out.pop()
    if out and fence is None:
        out[-1] = out[-1].rstrip()
    return "\n".join(out) + "\n" if out else ""


def _fenced(lines: list[str]) -> bool:
    return bool(re.match(r"^ {0,3}(`{3,}|~{3,})", lines[-1]))


@F.pandas_udf(T.StringType())
def normalize(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else clean(x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunks(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else split_chunks(x))


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("literals", T.ArrayType(T.StringType())))
def protected(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if x is None else protect(x) for x in text], columns=["text", "literals"])


def page_parts(text: Column) -> Column:
    """Array of page texts of a document with `<!-- Page number: N -->` markers; what stands before the first is part 0."""
    return F.split(text, "<!-- Page number: [0-9]+ -->")
