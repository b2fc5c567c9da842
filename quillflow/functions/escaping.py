"""Plain and styled text as Markdown that reads back as the same text: escapes only where a mark would be read.

Delimiter runs are judged by CommonMark's flanking rules and by whether the line holds a partner for them; what stands at the
start of a line by the blocks that it would begin. Styled runs are written with marks where these flank, else with tags.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

CODE = "\ue000"  # stands for a code span while its surroundings are judged
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_REFERENCE = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{0,31}|#[0-9]{1,7}|#[Xx][0-9A-Fa-f]{1,6});")
_BULLET = re.compile(r"(?:[-+*]|[0-9]{1,9}[.)])(?=\s|$)")
_BREAK = re.compile(r"([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_FENCE = re.compile(r"`{3,}(?=[^`]*$)|~{3,}")
_HEADING = re.compile(r"#{1,6}(?=\s|$)")
_UNDERLINE = re.compile(r"(?:=+|-+)[ \t]*$")
_TABLE = re.compile(r"[-:|][-:| \t]*$")
_TAG = re.compile(r"<(?=[A-Za-z/!?])")
_RUNS = {mark: re.compile(re.escape(mark) + "+") for mark in "*_~"}
_SPECIAL = re.compile(r"[\\<&\[\]|]")
Run = tuple[str, frozenset, str]  # text, styles (strong, em, del, code), address of a link or ""
MARKS = {"strong": "**", "em": "*", "del": "~~"}
ORDER = ("strong", "em", "del")


@lru_cache(maxsize=4096)
def _punctuation(c: str) -> bool:
    return c in _PUNCTUATION or c == CODE or unicodedata.category(c)[0] in "PS"


def flanking(before: str, after: str, mark: str) -> tuple[bool, bool]:
    """Whether a run of the mark between two characters (a space at the line's ends) can open and can close emphasis."""
    space = lambda c: c.isspace()
    left = not space(after) and (not _punctuation(after) or space(before) or _punctuation(before))
    right = not space(before) and (not _punctuation(before) or space(after) or _punctuation(after))
    if mark == "_":
        return left and (not right or _punctuation(before)), right and (not left or _punctuation(after))
    return left, right


def _emphasis(text: str, own: set[str]) -> set[int]:
    """Places of delimiter characters that a partner could pair with; own: marks that the line is written with, any of which
    could be one."""
    out: set[int] = set()
    for mark in "*_~":
        runs = []
        for m in _RUNS[mark].finditer(text):
            before, after = (text[m.start() - 1] if m.start() else " "), (text[m.end()] if m.end() < len(text) else " ")
            beside = before in "*_~" or after in "*_~"  # a neighbour of another kind may go or stay
            opens, closes = (True, True) if beside else flanking(before, after, mark)
            if mark != "~" or len(m[0]) <= 2:
                runs.append((m.span(), opens, closes))
        first_open = next((k for k, (_, opens, _) in enumerate(runs) if opens), len(runs))
        last_close = next((k for k in range(len(runs) - 1, -1, -1) if runs[k][2]), -1)
        for k, (span, opens, closes) in enumerate(runs):
            later, earlier = last_close > k, first_open < k
            if (opens and (later or mark in own)) or (closes and (earlier or mark in own)):
                out.update(range(*span))
    return out


def escapes(text: str, place: str = "paragraph", own: Iterable[str] = (), touched: frozenset | set = frozenset()) -> dict[int, str]:
    """What to write for characters of a text that would be read as a mark. place: paragraph, heading, cell or label (of a
    link); touched: places where a mark of the line's own stands in front."""
    out = {k: "\\" + text[k] for k in _emphasis(text, set(own))}
    if touched:
        for m in re.finditer(r"[*_~]+|\\|<", text):
            if any(m.start() <= k <= m.end() for k in touched):
                out.update({k: "\\" + text[k] for k in range(*m.span())})
    later: set[int] = set()  # lengths of runs of backticks behind; escaped ones are runs of one, as code knows no escapes
    fences = {m.start() for m in re.finditer(r"(?m)(?<=^)[ \t]*`{3,}", text)} if place == "paragraph" and "```" in text else set()
    for m in reversed(list(re.finditer("`+", text))):
        a, b = m.span()
        beside = CODE in text[max(a - 1, 0) : b + 1] or any(a <= k <= b for k in touched)
        line_start = a - len(text[:a]) + len(text[:a].rstrip(" \t")) in fences and b - a >= 3
        if b - a in later or beside or line_start or CODE in text[b:]:
            out.update({k: "&#96;" if beside else "\\`" for k in range(a, b)})
            later |= set() if beside else {1}
        else:
            later.add(b - a)
    opened = False
    for m in _SPECIAL.finditer(text):
        k, c = m.start(), m[0]
        after = text[k + 1] if k + 1 < len(text) else "\n"
        if c == "\\" and (after in _PUNCTUATION or after in ("\n", CODE)):
            out[k] = "\\\\"
        elif c == "<" and after.isascii() and (after.isalpha() or after in "/!?") and (touched or text.find(">", k) >= 0 or not text[text.rfind("\n", 0, k) + 1 : k].strip()):
            out[k] = "\\<"
        elif c == "&" and _REFERENCE.match(text, k):
            out[k] = "\\&"
        elif c == "[":
            opened = True
            if after == "^" or (k and text[k - 1] == "!") or place == "label":
                out[k] = "\\["
        elif c == "]" and ((opened and after == "(") or place == "label"):
            out[k] = "\\]"
        elif c == "|" and place == "cell":
            out[k] = "\\|"
    if place in ("paragraph", "heading"):
        _line_starts(text, place, out)
    return out


def _line_starts(text: str, place: str, out: dict[int, str]) -> None:
    at = 0
    for n, line in enumerate(text.split("\n")):
        first = at + len(line) - len(line.lstrip())
        own = line.strip()
        if place == "paragraph" and own:
            if m := _BREAK.match(own) or _FENCE.match(own):
                out.update({first + k: "\\" + c for k, c in enumerate(m[0]) if not c.isspace()})
            elif m := _BULLET.match(own):
                out[first + len(m[0]) - 1] = "\\" + m[0][-1]
            elif _HEADING.match(own) or own[0] == ">" or (n and (_UNDERLINE.match(own) or (_TABLE.match(own) and "-" in own))) or re.match(r"\[[^\]]+\]:", own):
                out[first] = "\\" + own[0]
        elif place == "heading" and (m := re.search(r"(?:^|[ \t])(#+)[ \t]*$", line)):
            out[at + m.end(1) - 1] = "\\#"
        at += len(line) + 1


def escaped(text: str, place: str = "paragraph") -> str:
    changes, parts, at = escapes(text, place), [], 0
    for k in sorted(changes):
        parts += (text[at:k], changes[k])
        at = k + 1
    out = "".join(parts) + text[at:]
    return out.replace("\n", "<br>") if place == "cell" else out


def _tidy(runs: Iterable[Run]) -> list[Run]:
    """Runs whose styles do not reach over white space at their ends, neighbours of a kind as one, without empty ones."""
    out: list[Run] = []

    def add(text: str, styles: frozenset, link: str) -> None:
        if text and out and out[-1][1:] == (styles, link):
            out[-1] = (out[-1][0] + text, styles, link)
        elif text:
            out.append((text, styles, link))

    for text, styles, link in runs:
        if "code" in styles:
            styles &= {"code"}
        core = text.strip()
        at = text.find(core) if core else len(text)
        add(text[:at], frozenset(), "" if not core else link)
        add(core, styles, link)
        add(text[at + len(core) :], frozenset(), link if core else "")
    return out


def _code(text: str) -> str:
    longest = max(map(len, re.findall("`+", text)), default=0)
    mark = "`" * (1 if longest != 1 else 2) if longest < 2 else "`" * (longest + 1)
    pad = " " if text[:1] in "` " or text[-1:] in "` " else ""
    return f"{mark}{pad}{text}{pad}{mark}".replace("\n", " ")


def styled(runs: Iterable[Run], place: str = "paragraph") -> str:
    """Runs of text with styles and links as Markdown."""
    own = _tidy(runs)
    parts = [CODE if "code" in s else t for t, s, _ in own]
    text, starts = "".join(parts), []
    for p in parts:
        starts.append((starts[-1] + len(prior)) if starts else 0)
        prior = p
    ends = [a + len(p) for a, p in zip(starts, parts)]
    used = {MARKS[x][0] for _, s, _ in own for x in s if x in MARKS}
    edges = {x for a, b, (_, s, link) in zip(starts, ends, own) if s or link for x in (a, b)}
    changes = escapes(text, place, used, edges)
    labels = {k for a, b, (_, _, link) in zip(starts, ends, own) if link for k in range(a, b)}
    changes.update({k: "\\" + text[k] for k in labels if text[k] in "[]"})
    out, open_, link = [], [], ""
    for k, (_, styles, to) in enumerate([*own, ("", frozenset(), "")]):
        edge = starts[k] if k < len(own) else len(text)
        before, after = (text[edge - 1] if edge else " "), (text[edge] if edge < len(text) else " ")
        keep = 0
        while keep < len(open_) and open_[keep][0] in styles and to == link:
            keep += 1
        while len(open_) > keep:
            name, mark = open_.pop()
            out.append(mark if mark[0] != "<" else f"</{name}>")
        if to != link:
            if link:
                out.append(f"](<{link}>)" if re.search(r"[\s()]", link) else f"]({link})")
            link = to
            if to:
                if out and out[-1].endswith("!"):
                    out[-1] = out[-1][:-1] + "&#33;"
                out.append("[")
        for name in ORDER:
            if name in styles and name not in [n for n, _ in open_]:
                end = next((ends[j] for j in range(k, len(own)) if j + 1 == len(own) or name not in own[j + 1][1] or own[j + 1][2] != to), len(text))
                close = flanking(text[end - 1], text[end] if end < len(text) else " ", MARKS[name][0])[1]
                # two marks side by side could be read as one run: only a run that stands by itself is written with marks
                alone = not open_ and styles == {name} and end == ends[k] and before not in "*_~" and after not in "*_~" and text[end - 1] not in "*_~" and text[end : end + 1] not in ("*", "_", "~")
                beside = k and own[k - 1][1] - {"code"} or (next((own[j + 1][1] for j in range(k, len(own) - 1) if name not in own[j + 1][1]), frozenset()) - {"code"})
                sound = alone and not beside and flanking(before, after, MARKS[name][0])[0] and close
                mark = MARKS[name] if sound else f"<{name}>"
                open_.append((name, mark))
                out.append(mark)
        if k < len(own):
            piece = own[k][0] if "code" in styles else None
            out.append(_code(piece) if piece is not None else "".join(changes.get(j, text[j]) for j in range(starts[k], ends[k])))
    done = "".join(out)
    return done.replace("\n", "<br>") if place == "cell" else done


def escaped_text(text: Column, place: str = "paragraph") -> Column:
    """Texts as Markdown of a place; most hold no mark and pass unread."""

    @F.pandas_udf("string")
    def go(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else escaped(x, place))

    risky = text.rlike(r"[*_~`\\<&\[\]|#>]|(?m)^\s*(?:[-+=:]|[0-9]{1,9}[.)])") | F.contains(text, F.lit("\n"))
    return F.when(risky, go(F.when(risky, text))).otherwise(text)
