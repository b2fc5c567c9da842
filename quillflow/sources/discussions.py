"""Pages that are discussions: a row for each reply, and the replies as one nested text.

What is read of a page is flat: replies in their order with an indent. The tree comes from joins over all of them
(`operators.threads`).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators import threads
from . import blocks as B
from .html import Blocks

# The classes that rows, indents, authors, dates and texts of replies have, and the pixels of an indent.
ROW, INDENT, AUTHOR, DATE, TEXT, PIXELS = "comtr", "ind", "hnuser", "age", "commtext", 40
_FIELDS = "key string, pos int, indent int, author string, said_at string, markdown string"


class _Replies(Blocks):
    """Collects replies beside the blocks: a reply's text are the blocks between its text's beginning and the next row."""

    def __init__(self, base):
        super().__init__(base)
        self.replies: list[dict] = []
        self.author: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = set(a.get("class", "").split())
        if tag == "tr" and ROW in classes:
            self._close()
            self.replies.append({"indent": 0, "author": None, "said_at": None, "from": None})
        own = self.replies[-1] if self.replies else None
        if own is not None and own["from"] is None:
            if tag == "td" and INDENT in classes and a.get("indent", "").isdigit():
                own["indent"] = int(a["indent"])
            elif tag == "img" and a.get("width", "").isdigit() and not own["indent"]:
                own["indent"] = int(a["width"]) // PIXELS
            elif tag == "a" and AUTHOR in classes:
                self.author = []
            elif DATE in classes and a.get("title"):
                own["said_at"] = a["title"].split(" ")[0]
            elif TEXT in classes:
                self._flush()
                own["from"], own["depth"], own["sinks"] = len(self.sinks[-1]), len(self.open), len(self.sinks)
        super().handle_starttag(tag, attrs)

    def handle_data(self, data):
        if self.author is not None and data.strip():
            self.replies[-1]["author"], self.author = data.strip(), None
        super().handle_data(data)

    def _pop(self):
        own = self.replies[-1] if self.replies else None
        if own and own["from"] is not None and "blocks" not in own and len(self.open) - 1 <= own["depth"]:
            self._flush()
            own["blocks"] = self.sinks[own["sinks"] - 1][own["from"] :]
        super()._pop()

    def _close(self):
        if self.replies and self.replies[-1]["from"] is not None and "blocks" not in self.replies[-1]:
            self._flush()
            self.replies[-1]["blocks"] = self.sinks[self.replies[-1]["sinks"] - 1][self.replies[-1]["from"] :]


def _text(blocks: list[tuple]) -> str:
    write = {"code": lambda t: "```\n" + t.split("\x1f")[-1] + "\n```", "quote": lambda t: "> " + t.replace("\n", "\n> "), "item": lambda t: "- " + t}
    return "\n\n".join(write.get(kind, str)(text) for kind, _, text, _ in blocks if kind != "warning")


def replies(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """key, pos, indent, author, said_at and markdown of the replies of each page; deleted ones have no text. Pages that are
    no discussion, nulls and damaged pages have no row."""
    rows = B.dealt(pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html"), F.col(url).alias("url")))

    def go(batches):
        for batch in batches:
            out = []
            for k, page, address in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if page is None or ROW not in page:
                    continue
                parser = _Replies(address)
                try:
                    parser.feed(page)
                    parser.close()
                    while parser.open:
                        parser._pop()
                    parser._close()
                except (ValueError, IndexError, AssertionError):
                    continue
                out += [(k, n, r["indent"], r["author"], r["said_at"], _text(r.get("blocks", []))) for n, r in enumerate(parser.replies)]
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[f.split()[0] for f in _FIELDS.split(", ")])

    return rows.mapInArrow(go, _FIELDS)


def discussion(found: DataFrame) -> DataFrame:
    """key, markdown: the replies of each page depth first, each as deep in quotation as it answers; one that has no text and
    no answers is left out."""
    placed = threads.trees(threads.with_parents(found, "key", "pos", "indent"), "key", "pos", "parent_pos")
    kept = placed.filter((F.col("markdown") != "") | (F.col("n_below") > 0))
    head = F.concat(F.lit("**"), F.coalesce("author", F.lit("[deleted]")), F.lit("**"), F.coalesce(F.concat(F.lit(" · "), "said_at"), F.lit("")))
    text = threads.quoted(F.concat(head, F.when(F.col("markdown") != "", F.concat(F.lit("\n\n"), "markdown")).otherwise("")), F.col("depth"))
    parts = F.array_sort(F.collect_list(F.struct("number", "depth", text.alias("text"))))
    # a blank line between replies, itself quoted as deep as both neighbours are
    def joined(s, x):
        gap = F.concat(F.lit("\n"), F.rtrim(F.repeat(F.lit("> "), F.least(s["depth"], x["depth"]))), F.lit("\n"))
        return F.struct(F.when(s["text"] == "", x["text"]).otherwise(F.concat(s["text"], gap, x["text"])).alias("text"), x["depth"].alias("depth"))

    whole = F.aggregate("parts", F.struct(F.lit("").alias("text"), F.lit(0).cast("int").alias("depth")), joined)["text"]
    return kept.groupBy("key").agg(parts.alias("parts")).select("key", F.concat(whole, F.lit("\n")).alias("markdown"))
