"""HTML pages as blocks.

A small tree builder on the standard library's tokenizer knows raw text, void elements and implied end tags; it emits each
block with the element it stands in, and each element with its interval in document order and what it holds itself. What
stands in a form, a table cell or a callout is collected apart and judged when the element ends. Which part of a page is its
article, and what of it is furniture, is then decided over the table of elements (`regions`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks as B, mathml, references, regions, streams, tree as R

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIP = set("script style template noscript svg iframe object canvas select button textarea math".split())
BLOCK = set(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = set("nav footer".split())
#: What an opening tag closes: itself and its kind, up to the containers that bound it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
WRAP = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`", "del": "~~", "s": "~~"}
#: How the words of a form's names begin where it is an entry box, and the words such a box has at most.
ENTRY_NAMES = "search|login|signin|signup|register|subscribe|newsletter|comment|password"
ENTRY_WORDS, NAMED_ENTRY_WORDS = 20, 60
#: Limits of a data table without header cells, and the pixels below which an image shows nothing.
CELL_WORDS, COLUMNS, SPAN, SMALL = 40, 256, 64, 33
#: What stands between a title and the site's name.
SEPARATORS = (" | ", " - ", " -- ", " · ", " — ", " – ")
# Names of sections of notes, ids of notes and of what refers to them, and signs that stand for numbers or lead back.
NOTE_ROLES = {"doc-footnote", "doc-footnotes", "doc-endnote", "doc-endnotes"}
NOTE_CLASSES = {"footnote", "footnotes", "footnotes-list", "footnote-definition", "endnotes", "references", "reflist"}
NOTE_HEADINGS = {"footnote", "footnotes", "foot notes", "endnotes", "end notes", "note", "notes", "reference", "references", "sidenotes"}
NOTE_ID = re.compile(r"(?:user-content-)?(?:_?(?:fn|ftn|ftnt|edn|footnote|endnote)|cite_note)(?![-_:]?ref)[-_:]?\w", re.I)
BACK_ID = re.compile(r"(?:user-content-)?(?:_?(?:fn|ftn|ftnt|edn|footnote|endnote|cite)[-_:]?_?ref|r(?:ef)?[-_:]?\d)", re.I)
NOTE_SIGN = re.compile(r"[\[(]?(?:[1-9][0-9]{0,3}|[*†‡§]{1,3}|[a-z])[\])]?")
BACK_SIGNS = set("↩ ↩︎ ↑ ⤴ ^ ⏎ ← 🔙".split())
# What a saved message body of a web mail folds away.
MAIL_BODY, MAIL_HISTORY, MAIL_HEADER = "a3s", {"gmail_quote", "gmail_attr", "adL"}, "divRplyFwdMsg"
META = (
    "author description og:description twitter:description og:title twitter:title og:site_name application-name article:published_time article:author"
).split()
CALLOUT = re.compile(r"^(?:markdown-alert-|alert-|admonition-)?(note|tip|important|warning|caution|danger|info|success|hint|error|example|quote|abstract|question|bug)$")


def _tokens(*values: str) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", " ".join(values).lower()))


def _number(text: str) -> float | None:
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*(?:px)?\s*", text)
    return float(m[1]) if m and float(m[1]) > 0 else None


def best_candidate(srcset: str) -> str | None:
    """The address of the largest candidate of a srcset, by width or density."""
    best = (-1.0, None)
    for url, size in re.findall(r"([^\s,]\S*[^\s,])(?:\s+([0-9.]+)[wx])?\s*(?:,|$)", srcset):
        best = max(best, (float(size or 1), url), key=lambda x: x[0])
    return best[1]


class Blocks(HTMLParser):
    """Collects (kind, level, text) with the state of the open elements."""

    def __init__(self, base: str | None, often: bool = True):
        super().__init__(convert_charrefs=True)
        self.often = often  # whether the site's name goes from a title however often it stands there
        self.base, self.open, self.text = base or "", [], []
        self.sinks: list[list[tuple]] = [[]]  # the innermost form, cell or callout collects its own blocks
        self.skip, self.pre, self.links, self.tables, self.numbers = 0, 0, [], [], []
        self.table_count, self.lang, self.lazy, self.raw = 0, "", False, None
        self.formula, self.told = None, False  # an open formula, and whether its own TeX was found
        self.depth_warned = False
        self.title, self.heading, self.meta, self.ld, self.time = None, None, {}, [], None
        self.ids: set[str] = set()  # that headings have
        self.contents: list[list] = []  # outermost lists: their blocks, fragments of links, whether anything else is said
        self.names: list[str] = []  # tags of the open elements
        self.note, self.note_depth = None, 0  # the note whose definition is open
        self.note_section, self.note_heading = 0, False  # open sections of notes; whether the last heading names one
        self.mail, self.mail_over = 0, False  # open bodies of saved messages; whether what follows is history
        self.chrome, self.inner, self.here = 0, 0, None  # open chrome, open article or main, the element that just ends
        self.tree, self.spoken = R.Tree(), set()  # elements that the text since the last block stands in

    # -- element stack
    def _push(self, tag: str, mark: str, a: dict) -> None:
        node = self.tree.start(tag, a, mark == "chrome") if mark != "skip" and not self.skip else None
        self.open.append((tag, mark, a, node))
        self.names.append(tag)
        self.chrome += mark == "chrome"
        self.inner += tag in ("article", "main")
        self.note_section += self._notes(a)
        if MAIL_BODY in a.get("class", "").split():
            self.mail, self.mail_over = self.mail + 1, False
        if mark != "skip" and not self.skip and self.note is None:
            self._defines(tag, a)

    def _notes(self, a: dict) -> bool:
        """Whether an element is a section of notes, or a note, by its role, class or id."""
        names = {*a.get("class", "").lower().split(), a.get("id", "").lower()}
        return bool(NOTE_ROLES & set(a.get("role", "").split()) or NOTE_CLASSES & names or "data-footnotes" in a or a.get("data-type") == "footnote")

    def _defines(self, tag: str, a: dict) -> None:
        """Begins the definition of a note: a block in a section of notes, or one whose id (or that of an anchor or label in
        front of its text) is a note's."""
        name = a.get("id") or (a.get("name") if tag == "a" else None)
        if not name or BACK_ID.match(name):
            return
        here = self.note_section or self.note_heading
        if tag in ("li", "p", "div", "dd", "aside", "tr") and (NOTE_ID.match(name) or (here and not self._notes({"id": name}) and tag != "div") or "doc-footnote" in a.get("role", "")):
            self.note, self.note_depth = name, len(self.open)
        elif tag in ("a", "sup", "span", "b", "strong") and (NOTE_ID.match(name) or here) and not "".join(self.text).strip("\1\2* "):
            block = next((k for k in range(len(self.names) - 1, -1, -1) if self.names[k] in ("p", "li", "dd", "div")), None)
            if block is not None:
                self.note, self.note_depth = name, block + 1

    def _pop(self) -> None:
        entry = self.open.pop()
        self.names.pop()
        self._end(entry)
        self.chrome -= entry[1] == "chrome"
        self.inner -= entry[0] in ("article", "main")
        self.note_section -= self._notes(entry[2])
        self.mail -= MAIL_BODY in entry[2].get("class", "").split()
        if self.note is not None and len(self.open) < self.note_depth:
            self.note = None
        if entry[3] is not None:
            self.tree.end(entry[3])

    def _close_to(self, names: set[str], bounds: set[str]) -> None:
        found = None
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k][0]
            if tag in bounds:
                break
            if tag in names:
                found = k
        while found is not None and len(self.open) > found:
            self._pop()

    def _hidden(self, a: dict) -> bool:
        style, classes = a.get("style", "").replace(" ", "").lower(), a.get("class", "").split()
        if "hidden" in a or "display:none" in style or "visibility:hidden" in style:
            return True
        if any(re.fullmatch(r"d-(?:sm|md|lg|xl|xxl)-(?!none).+|(?:sm|md|lg|xl|2xl):(?:block|flex|grid|inline|table|contents).*", c) for c in classes):
            return False  # shown again at some width
        return any(c.rsplit(":", 1)[-1] in ("hidden", "invisible", "is-hidden", "d-none") for c in classes if "[" not in c)

    def _chrome(self, tag: str, a: dict) -> bool:
        if R.chrome(tag, a):
            return True
        if tag == "footer":  # one of a part of the page belongs to it
            inner = next((n for n in reversed(self.names) if n in ("article", "section", "figure", "blockquote", "aside", "nav", "td", "th", "body")), None)
            return inner not in ("article", "section", "figure", "blockquote")
        return tag in CHROME

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        names = self.names
        if self.formula is not None:
            self.formula.start(tag, a)
            if tag != "annotation" and tag != "math":
                if tag not in VOID:
                    self._push(tag, "", a)
                return
        if tag in BLOCK and "p" in names:
            self._close_to({"p"}, {"td", "th", "table", "li", "button"})
        if tag in CLOSES:
            self._close_to(*CLOSES[tag])
        if tag in VOID:
            self._void(tag, a)
            return
        if tag in SKIP or self._hidden(a) or self._history(tag, a):
            if tag == "script" and a.get("type", "").strip().lower() == "application/ld+json":
                self.raw = []
            elif tag == "math":
                self.math = "$$" if a.get("display") == "block" else "$"
                if self.formula is None and not self.skip and not self._hidden(a):
                    self.formula, self.told = mathml.Formula(a), False
            self._push(tag, "skip", a)
            self.skip += 1
            return
        if tag == "annotation" and "tex" in a.get("encoding", "") and "math" in names:
            self.raw = []
        callout = self._callout(tag, a)
        chrome = not callout and self._chrome(tag, a)
        if tag in BLOCK or chrome or callout:
            self._flush()
            self.here = None
        self._push(tag, "chrome" if chrome else "callout" if callout else "", a)
        if len(self.open) > 256 and not self.depth_warned:
            self.depth_warned = True
            self.sinks[0].append(("warning", 0, "elements nested deeper than 256 are read as text", 0))
        if self.skip:
            return
        if any(len(n) == 2 and n[0] == "h" and n[1].isdigit() for n in names):
            self.ids.update(x for x in (a.get("id"), a.get("name")) if x)
        if tag in ("pre", "code") or self.pre:
            self._language(a)
        if tag == "pre":
            self.pre += 1
        elif tag == "table":
            self.table_count += 1
            self.tables.append({"rows": [], "number": self.table_count, "layout": a.get("role", "").strip().lower() in ("presentation", "none")})
        elif tag == "tr" and self.tables:
            self.tables[-1]["rows"].append((any(n == "thead" for n in names), []))
        elif tag in ("ol", "ul"):
            start = a.get("start", "")
            if not self.numbers:
                self.contents.append([[], False])
                self.sinks.append([])
            self.numbers.append((int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1) if tag == "ol" else None)
        elif tag == "q":
            self.text.append("“")
        elif tag == "time" and self.time is None and re.match(r"[0-9]{4}-[0-9]{2}", a.get("datetime", "").strip()):
            self.time = a["datetime"].strip()
        elif tag == "a":
            self.links.append((a.get("href", ""), len(self.text)))
        elif tag in WRAP and not self.pre:
            self.text.append("\1" + WRAP[tag])
        if tag in ("td", "th", "form", "caption") or callout:
            self.sinks.append([])

    def _history(self, tag: str, a: dict) -> bool:
        """Within a saved message: quoted history, the client's header of it and all behind, folded text and controls."""
        if not self.mail:
            return False
        self.mail_over = self.mail_over or a.get("id") == MAIL_HEADER
        cite = tag == "blockquote" and a.get("type", "").lower() == "cite"
        return self.mail_over or cite or a.get("role") == "button" or bool(MAIL_HISTORY & set(a.get("class", "").split()))

    def _callout(self, tag: str, a: dict) -> str:
        classes = a.get("class", "").lower().split()
        if self.skip or not {"callout", "markdown-alert", "alert", "admonition"} & set(classes):
            return ""
        kinds = [m[1] for c in [a.get("data-callout", "").lower(), *classes] if (m := CALLOUT.match(c))]
        return kinds[0] if kinds else "note" if "admonition" in classes or "callout" in classes else ""

    def _language(self, a: dict) -> None:
        found = [m[1] for c in a.get("class", "").split() if (m := re.fullmatch(r"(?:language|lang|highlight-source|brush:)-?([A-Za-z0-9+#.-]+)", c))]
        self.lang = (a.get("data-lang") or a.get("data-language") or (found or [self.lang])[0]).lower()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        names = self.names
        if self.formula is not None:
            self.formula.end(tag)
        if tag not in names:
            return
        at = len(names) - 1 - names[::-1].index(tag)
        if tag not in BLOCK and any(n in BLOCK and n != "p" for n in names[at + 1 :]):
            return  # a stray inline end tag does not close the blocks within it
        while len(self.open) > at:
            self._pop()

    def _end(self, entry: tuple) -> None:
        self.here = entry[3]
        self._ended(*entry)
        self.here = None

    def _ended(self, tag: str, mark: str, a: dict, node: int | None) -> None:
        if tag == "annotation" and self.raw is not None:
            tex, self.raw = "".join(self.raw).strip(), None
            if tex and self.skip == 1:
                self.text.append(f"{self.math}{tex}{self.math}")
                self.told = True
        if mark == "skip":
            if tag == "script" and self.raw is not None:
                self._linked_data("".join(self.raw))
                self.raw = None
            elif tag == "math" and self.formula is not None and self.skip == 1:
                tex, deep = a.get("alttext", "").strip() or self.formula.tex(), self.formula.deep
                if deep:
                    self.sinks[0].append(("warning", 0, "formulas nested deeper than 64 are read as text", 0))
                if tex and not self.told:
                    self.text.append(tex if deep else f"{self.math}{tex}{self.math}")
                self.formula = None
            self.skip -= 1
            return
        if self.skip:
            return
        if tag == "a" and self.links:
            href, at = self.links.pop()
            if self.contents and self.numbers:
                self.contents[-1][0].append(href.strip()[1:] if href.strip().startswith("#") else None)
            label = "".join(self.text[at:]).strip()
            if self._leads_back(href, label, a):
                self.text[at:] = []
            elif href and not href.lower().startswith(("javascript:", "data:")):
                link = f"[{label}]({urljoin(self.base, href)})" if label else ""
                self.text[at:] = [references.mark(fragment, label, link)] if label and (fragment := self._refers(href, label, a)) else [link]
        elif tag in WRAP and not self.pre:
            self.text.append(WRAP[tag] + "\2")
        elif tag == "q":
            self.text.append("”")
        elif tag in BLOCK or mark:
            self._flush(tag, mark, a)
            self.here = node
        if tag in ("td", "th"):
            self._cell(tag, a, self.sinks.pop())
        elif tag == "caption":
            inner = self.sinks.pop()
            self.sinks[-1].extend(inner)
        elif tag == "table" and self.tables:
            self._table(self.tables.pop(), mark)
        elif tag == "form":
            self._form(a, self.sinks.pop())
        elif mark == "callout":
            self._end_callout(self._callout(tag, a), self.sinks.pop())
        if tag == "pre":
            self.pre -= 1
            self.lang = "" if not self.pre else self.lang
        elif tag in ("ol", "ul") and self.numbers:
            self.numbers.pop()
            if not self.numbers and self.contents:
                self._end_list(*self.contents.pop(), self.sinks.pop())

    # -- notes
    def _fragment(self, href: str) -> str | None:
        """The fragment of an address within the page."""
        where, _, fragment = href.strip().partition("#")
        return unquote(fragment) if fragment and (not where or where == self.base.partition("#")[0]) else None

    def _refers(self, href: str, label: str, a: dict) -> str | None:
        """The note that a link may refer to: it says so, or it has a number or sign for a label and looks like a reference."""
        fragment, label = self._fragment(href), label.replace("\1", "").replace("\2", "").strip("*` ")
        if not fragment or self.note is not None or self.pre or BACK_ID.match(fragment):
            return None
        said = "doc-noteref" in a.get("role", "") or "data-footnote-ref" in a or bool({"footnote-ref", "footnote", "footnote-reference", "noteref"} & set(a.get("class", "").lower().split()))
        sign = bool(NOTE_SIGN.fullmatch(label))
        return fragment if said or (sign and (label.strip("[]()").isdigit() or "sup" in self.names or NOTE_ID.match(fragment))) else None

    def _leads_back(self, href: str, label: str, a: dict) -> bool:
        fragment = self._fragment(href)
        if self.note is None or fragment is None:
            return False
        classes = a.get("class", "").lower()
        return label.strip("\1\2* ") in BACK_SIGNS or "doc-backlink" in a.get("role", "") or "backref" in classes or "backlink" in classes or bool(BACK_ID.match(fragment))

    # -- what is judged as a whole
    def _end_list(self, fragments: list, other: bool, blocks: list) -> None:
        """A list of three links or more that all lead into the page, and say nothing else, may be its table of contents:
        whether they lead to headings is known at the page's end."""
        if len(fragments) >= 3 and None not in fragments and not other:
            blocks = [(f"{kind}\x1f" + "\x1f".join(fragments), *rest) for kind, *rest in blocks]
        self.sinks[-1].extend(blocks)

    def _form(self, a: dict, blocks: list) -> None:
        """An entry box goes: a form of few words, or of some more if its names say what is entered."""
        words = sum(len(text.split()) for kind, _, text, _ in blocks if kind != "chrome")
        named = a.get("role", "").strip().lower() == "search" or any(re.match(ENTRY_NAMES, w) for w in _tokens(*(a.get(k, "") for k in ("class", "id", "name", "action"))))
        if words > (NAMED_ENTRY_WORDS if named else ENTRY_WORDS):
            self.sinks[-1].extend(blocks)

    def _end_callout(self, kind: str, blocks: list) -> None:
        shown = [(k, text) for k, _, text, _ in blocks if k not in ("chrome", "warning")]
        if shown:
            title = shown.pop(0)[1] if len(shown) > 1 and len(shown[0][1]) <= 60 and shown[0][0] in ("paragraph", "heading") else kind.capitalize()
            body = "\n\n".join(("- " if k == "item" else "") + text for k, text in shown)
            self._emit("quote", 0, f"[!{kind}] {title}\n{body}", "")

    def _cell(self, tag: str, a: dict, blocks: list) -> None:
        if not self.tables or not self.tables[-1]["rows"]:
            self.sinks[-1].extend(blocks)
            return
        span = lambda k: min(max(int(a[k]), 1), SPAN) if re.fullmatch(r"[0-9]{1,4}", a.get(k, "")) else 1
        self.tables[-1]["rows"][-1][1].append((tag == "th", span("colspan"), span("rowspan"), blocks))

    def _table(self, table: dict, mark: str) -> None:
        """A grid with header cells or of short, mostly filled cells becomes rows; other tables lay out a page."""
        rows = [r for r in table["rows"] if r[1]]
        text = lambda cell: " ".join(t.replace("\n", " ") for k, _, t, _ in cell[3] if k != "warning")
        headed = any(head or any(c[0] for c in cells) for head, cells in rows)
        cells = [c for _, row in rows for c in row]
        shown = [c for c in cells if text(c)]
        width = max((sum(c[1] for c in row) for _, row in rows), default=0)
        plain = all(len(c[3]) <= 1 and len(text(c).split()) <= CELL_WORDS and all(k in ("paragraph", "chrome", "code") for k, *_ in c[3]) for c in shown)
        filled = sum(any(text(c) for c in row) for _, row in rows)
        data = plain and not table["layout"] and filled >= 2 and width >= 2 and (len(cells) - len(shown)) * 3 < len(cells) * 2
        if not shown or not (headed or data) or width > COLUMNS:
            for c in cells:
                self.sinks[-1].extend(c[3])
            return
        if self.here is not None:
            self.tree.data_table(self.here)
        grid, carry = [], [0] * (width + SPAN)
        for _, row in rows:
            line: list[str] = []

            def covered():
                while len(line) < len(carry) and carry[len(line)] > 0:
                    carry[len(line)] -= 1
                    line.append("")

            for cell in row:
                covered()
                for k in range(len(line), min(len(line) + cell[1], len(carry))):
                    carry[k] = cell[2] - 1
                line += [text(cell)] + [""] * (cell[1] - 1)
            covered()
            grid.append(line)
        columns = [k for k in range(max(map(len, grid))) if any(k < len(line) and line[k] for line in grid)]
        first = next((k for k, (head, _) in enumerate(rows) if head), 0)
        grid = [grid[first], *grid[:first], *grid[first + 1 :]]
        if headed and not rows[first][0] and not all(c[0] for c in rows[0][1]):
            grid.insert(0, [""] * len(columns))  # only rows have header cells
        for line in grid if headed else [x for x in grid if any(x)]:
            self._emit("row", table["number"], "\x1f".join(line[k] if k < len(line) else "" for k in columns), mark)

    def _linked_data(self, text: str) -> None:
        def collect(value, depth):
            if isinstance(value, dict) and depth <= 64:
                self.ld.append({k: v for k, v in value.items() if k != "@graph"})
                collect(value.get("@graph"), depth + 1)
            elif isinstance(value, list) and depth <= 64:
                for x in value:
                    collect(x, depth + 1)

        try:
            collect(json.loads(text), 0)
        except (ValueError, RecursionError):
            pass

    # -- text
    def _image(self, a: dict) -> None:
        if any((n := _number(a.get(k, ""))) is not None and n < SMALL for k in ("width", "height")):
            return
        sources = [a.get(k, "") for k in ("data-src", "data-original", "data-lazy-src")]
        sets = [best_candidate(a[k]) or "" for k in ("data-srcset", "srcset") if a.get(k)]
        src = next((s for s in [*sources, *sets, a.get("src", "")] if s and not s.startswith("data:")), None)
        self.lazy = src is None
        if src:
            alt = re.sub(r"[\[\]()]", "_", " ".join(a.get("alt", "").split()))
            self.text.append(f"![{alt}]({urljoin(self.base, src)})")

    def _void(self, tag, a):
        if self.skip:
            if tag == "img" and self.lazy and self.skip == 1 and "noscript" in self.names:  # a lazy image's real address
                self._image(a)
            return
        if tag == "br":
            self.text.append("\n")
        elif tag == "hr":
            self._flush()
            self.here = None
            self._emit("rule", 0, "---", "")
        elif tag == "img":
            self.tree.end(self.tree.start(tag, a, False))
            self._image(a)
        elif tag == "base" and a.get("href"):
            self.base = urljoin(self.base, a["href"])
        elif tag == "meta" and a.get("content", "").strip():
            name = (a.get("property") or a.get("name") or "").strip().lower()
            if name in META:
                self.meta.setdefault(name, " ".join(a["content"].split()))
        elif tag == "link" and a.get("rel", "").lower() == "canonical" and a.get("href"):
            self.meta.setdefault("canonical", urljoin(self.base, a["href"]))

    def handle_data(self, data):
        names = self.names
        if self.formula is not None:
            self.formula.text(data)
        if self.raw is not None:
            self.raw.append(data)
        elif names and names[-1] == "title" and "body" not in names:
            self.title = self.title or " ".join(data.split()) or None
        elif not self.skip:
            if self.contents and self.numbers and not self.links and any(c.isalpha() for c in data):
                self.contents[-1][1] = True
            if data.strip():
                self.spoken.add(self.tree.text(data))
            self.text.append(data if self.pre else " ".join(data.split()).join((" " * data[:1].isspace(), " " * data[-1:].isspace())) if data.strip() else " ")

    def _take(self) -> str:
        text, self.text, self.links = "".join(self.text), [], [(h, 0) for h, _ in self.links]
        if not self.pre:
            text = "\n".join(" ".join(line.split()) for line in text.replace("\xad", "").split("\n"))
            for mark in ("**", "*", "`", "~~"):
                if text.count("\1" + mark) != text.count(mark + "\2"):
                    text = text.replace("\1" + mark, "").replace(mark + "\2", "")
                text = text.replace(f"\1{mark}{mark}\2", "").replace(f"\1{mark} ", f" {mark}").replace(f" {mark}\2", f"{mark} ")
        return text.replace("\1", "").replace("\2", "").strip("\n" if self.pre else None)

    def _flush(self, tag: str = "", mark: str = "", a: dict | None = None) -> None:
        text, spoken, self.spoken = self._take(), self.spoken, set()
        if not text:
            return
        if spoken:
            self.here = self.tree.common(spoken)
        names = [*self.names, tag]
        bound = max((k for k, n in enumerate(names) if n in ("td", "th", "caption")), default=-1)
        names = names[bound + 1 :] if bound < len(names) - 1 else []
        head = next((n for n in reversed(names) if len(n) == 2 and n[0] == "h" and n[1].isdigit()), None)
        if self.pre:
            self._emit("code", 0, f"{self.lang}\x1f{text}" if self.lang else text, mark)
        elif head:
            self.heading = self.heading or (text.replace("\n", " ") if head == "h1" else None)
            self.note_heading = text.strip(" :").lower() in NOTE_HEADINGS
            self._emit("heading", int(head[1]), text.replace("\n", " "), mark)
        elif "li" in names and self.numbers:
            level = sum(1 if n is None else 2 for n in self.numbers[:-1])
            if self.numbers[-1] is None:
                self._emit("item", level, text.replace("\n", " "), mark)
            else:
                self._emit("ordered", level, f"{self.numbers[-1]}. " + text.replace("\n", " "), mark)
                self.numbers[-1] += 1
        elif "blockquote" in names:
            self._emit("quote", 0, text, mark)
        else:
            self._emit("paragraph", 0, text.replace("\n", "  \n"), mark)

    def _emit(self, kind, level, text, mark):
        if mark == "chrome" or self.chrome:
            kind = "chrome"
        elif self.inner:
            level = level + 100
        if self.note is not None and kind != "chrome":
            kind, level, text = "note", level - level % 100, references.note_text(self.note, kind, level % 100, text)
        at = self.here if self.here is not None else next((x[3] for x in reversed(self.open) if x[3] is not None), 0)
        self.sinks[-1].append((kind, level, text, at))

    # -- about the page
    def _ld_text(self, key: str) -> str | None:
        return next((d[key].strip() for d in self.ld if isinstance(d.get(key), str) and d[key].strip()), None)

    def _site(self) -> str | None:
        return self.meta.get("og:site_name") or self.meta.get("application-name")

    def _page_title(self) -> str | None:
        """The best of the page's candidates for a title: the first of headline, linked name, title and social title that says
        anything beside the site's name. A headline is no candidate if it shares its letters with none of the page's own titles
        while the heading does with one. One that is cut short gives way to a longer form of itself, and one that goes on
        behind the headline or heading to that."""
        said = {"headline": self._ld_text("headline"), "name": self._ld_text("name"), "title": self.title, "social": self.meta.get("og:title") or self.meta.get("twitter:title"), "heading": self.heading}
        letters = {kind: "".join(filter(str.isalnum, (text or "").lower())) for kind, text in said.items()}
        echoed = lambda kind, others: any(letters[kind] and letters[o] and (letters[kind] in letters[o] or letters[o] in letters[kind]) for o in others)
        if letters["headline"] and echoed("heading", ("title", "social")) and not echoed("headline", ("heading", "title", "social")):
            said["headline"] = None
        bare = {kind: _bare_title(said[kind], self._site(), self.often) for kind in ("headline", "name", "title", "social")}
        best = next(filter(None, bare.values()), None)
        cut = re.sub(r"(?:…|\.\.\.)$", "", best or "").rstrip()
        if best and cut != best.rstrip():
            best = next((t for t in (bare["title"], bare["social"]) if t and t.startswith(cut) and len(t) > len(best) and not t.endswith(("…", "..."))), best)
        heads = [" ".join(said[kind].split()) for kind in ("headline", "heading") if said[kind]]
        return next((h for h in heads if best and best.startswith(h + " | ")), best)

    def _author(self) -> str | None:
        address = lambda x: x.startswith("//") or ("://" in x and not re.search(r"\s", x))

        def names(value, follow=True):
            if isinstance(value, str):
                return [" ".join(value.split())] if value.strip() and not address(value.strip()) else []
            if isinstance(value, dict):
                if isinstance(value.get("name"), str):
                    return names(value["name"])
                return next((names(d, False) for d in self.ld if follow and value.get("@id") and d.get("@id") == value["@id"]), [])
            if isinstance(value, list):
                person = lambda v: isinstance(v, dict) and "Person" in (v.get("@type") if isinstance(v.get("@type"), list) else [v.get("@type")])
                some = [v for v in value if person(v)] or value
                return list(dict.fromkeys(n for v in some for n in names(v, follow)))
            return []

        own = self.meta.get("author")
        if own and not address(own):
            return own
        found = next((n for d in self.ld if (n := names(d.get("author")))), [])
        other = self.meta.get("article:author")
        return ", ".join(found) or (other if other and not address(other) else None)

    def about(self) -> Iterator[tuple[str, int, str]]:
        if title := self._page_title():
            yield "title", 0, title
        publisher = next((d["publisher"] for d in self.ld if d.get("publisher")), None)
        publisher = publisher.get("name") if isinstance(publisher, dict) else publisher
        canonical = self.meta.get("canonical")
        if canonical and urlsplit(self.base).path.strip("/") and not urlsplit(canonical).path.strip("/"):
            canonical = None  # a home page is not the name of a deeper one
        found = {
            "author": self._author(), "site": self._site() or (publisher if isinstance(publisher, str) else None),
            "published": self.meta.get("article:published_time") or self._ld_text("datePublished") or self.time,
            "description": next((self.meta[k] for k in ("description", "og:description", "twitter:description") if k in self.meta), None), "canonical": canonical,
        }
        for key, value in found.items():
            if value:
                yield "meta", 0, f"{key}\x1f{value}"


def _bare_title(text: str | None, site: str | None, often: bool = True) -> str | None:
    """A title without the site's name and a separator at either end, however often, or once at its end if not often, so that
    a title that ends in the site's name itself keeps it; over 300 characters it ends at a word."""
    title, name = " ".join((text or "").split()), re.escape(" ".join((site or "").split()))
    if name:
        between = "(?:" + "|".join(map(re.escape, SEPARATORS)) + ")"
        title = re.sub(f"^(?:{name}{between})+|(?:{between}{name})+$" if often else f"{between}{name}$", "", title)
    return re.sub(r"(?s)^(.{1,300})(?<!\s) .*$|^(.{300}).*$", lambda m: (m[1] or m[2]) + "…", title) if len(title) > 300 else title or None


def _parsed(html: str, url: str | None, often: bool = True) -> Blocks:
    parser = Blocks(url, often)
    parser.feed(streams.opened(streams.restored(html, bounded=False)))
    parser.close()
    while parser.open:
        parser._pop()
    parser._flush()
    return parser


def _shown(parser: Blocks) -> Iterator[tuple[str, int, str, int]]:
    for sink in parser.sinks:
        for kind, level, text, at in sink:
            kind, *fragments = kind.split("\x1f")
            if not fragments or not parser.ids.issuperset(fragments):
                yield kind, level, text, at


def page_blocks(html: str, url: str | None) -> Iterator[tuple[str, int, str]]:
    """Blocks of a whole page, chrome included; those within an article or main element have a level 100 higher."""
    parser = _parsed(html, url)
    yield from parser.about()
    for kind, level, text, _ in _shown(parser):
        yield kind, level, text


_BLOCK = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("at", pa.int32())])
_KINDS = {"int": pa.int32(), "string": pa.string()}
ELEMENTS = 4096  # that a worker holds before they leave, but for those of one page


def closed_references(html: Column) -> Column:
    """A page in which only character references that end with a semicolon are references: `&amp` at the end of a text that was
    cut short stays what it is, where a browser reads `&`."""
    return F.regexp_replace(html, "&(?=(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[Xx][0-9A-Fa-f]+)(?![A-Za-z0-9;]))", "&amp;")


def elements(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", often: bool = True) -> DataFrame:
    """The elements of each page, one row each, as `tree.SCHEMA` has them, in front of which stand key and blocks: all blocks
    of the page with the element that each stands in, on the row of element 0 only. A page that fails has an error block."""
    fields = [(name, _KINDS[kind]) for name, kind in (c.split() for c in R.SCHEMA.split(", "))]
    rows = B.dealt(pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html"), F.col(url).alias("url")))

    def packed(keys, blocks, nodes):
        columns = zip(*nodes) if nodes else [()] * len(fields)
        arrays = [pa.array(keys, pa.string()), pa.array(blocks, pa.list_(_BLOCK)), *(pa.array(c, t) for c, (_, t) in zip(columns, fields))]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "blocks", *(name for name, _ in fields)])

    def go(batches):
        """A page is taken from its batch when its turn comes, and elements leave before there are many."""
        for batch in batches:
            keys, blocks, nodes = [], [], []
            for row in range(batch.num_rows):
                k, page, address = (batch.column(i)[row].as_py() for i in range(3))
                if page is None:
                    continue
                try:
                    parser = _parsed(page, address, often)
                    own = [(*block, 0) for block in parser.about()] + [(kind, level % 100, text, at) for kind, level, text, at in _shown(parser)]
                    found = list(parser.tree.rows())
                except Exception as e:  # a damaged page is a row, not a failure
                    own, found = [("error", 0, f"{type(e).__name__}: {e}"[:500], 0)], list(R.Tree().rows())
                keys += [k] * len(found)
                blocks += [[dict(zip(("pos", "kind", "level", "text", "at"), (pos, *b))) for pos, b in enumerate(own)]] + [None] * (len(found) - 1)
                nodes += found
                if len(keys) >= ELEMENTS:
                    yield packed(keys, blocks, nodes)
                    keys, blocks, nodes = [], [], []
            if keys:
                yield packed(keys, blocks, nodes)

    return rows.mapInArrow(go, f"key string, blocks array<struct<pos int, kind string, level int, text string, at int>>, {R.SCHEMA}")


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", often: bool = True) -> DataFrame:
    """Blocks of each page's article, without chrome and furniture; nulls give no block. Each page is parsed once, and one
    shuffle by key serves all that follows. often: whether the site's name goes from a title however often it stands there."""
    return regions.article(elements(pages, key, html, url, often))


def metadata(blocks: DataFrame) -> DataFrame:
    """key, title, author, site, published, description and canonical address of each page; null where it names none."""
    value = F.split_part("text", F.lit("\x1f"), F.lit(2))
    named = lambda k: F.max(F.when((F.col("kind") == "meta") & F.col("text").startswith(k + "\x1f"), value)).alias(k)
    title = F.max(F.when(F.col("kind") == "title", F.col("text"))).alias("title")
    return blocks.groupBy("key").agg(title, *[named(k) for k in ("author", "site", "published", "description", "canonical")])
