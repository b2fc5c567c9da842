"""Text formats as blocks: encodings, delimited text, JSON, XML, notebooks and light markup."""

from __future__ import annotations

import csv
import io
import json
import re
import xml.parsers.expat
from collections.abc import Iterator

from . import grids, references

#: Delimiters in the order that breaks ties, and legacy encodings with the range of their frequent characters.
DELIMITERS = (",", ";", "\t", "|")
LEGACY = ("gb18030", "big5", "shift_jis", "euc_jp", "euc_kr")


def decode(data: bytes) -> tuple[str, str | None]:
    """Text of a file without a declared encoding, and a warning where the choice was close.

    A byte-order mark decides, then valid UTF-8, then the East Asian encoding whose reading has by far the most frequent
    characters (a score of 0.7 and a lead of 0.2), else Windows-1252.
    """
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace"), None
    try:
        return data.decode("utf-8"), None
    except UnicodeDecodeError:
        pass
    scores = []
    for name in LEGACY:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        wide = [c for c in text if ord(c) > 127]
        scores.append((sum(_frequent(c, name) for c in wide) / max(len(wide), 1), name, text))
    lone = re.findall(rb"(?<![\x80-\xff])[\x80-\xff](?![\x80-\xff])", data)
    latin = len(lone) / max(sum(b > 127 for b in data), 1)
    scores.sort(key=lambda s: -s[0])
    if scores and scores[0][0] >= 0.7 and scores[0][0] - max([latin, *[s[0] for s in scores[1:]]]) >= 0.2:
        return scores[0][2], None
    warning = "the encoding is uncertain; the text is read as Windows-1252" if scores and scores[0][0] >= 0.7 else None
    return data.decode("cp1252", "replace"), warning


def decode_html(data: bytes, declared: str | None = None) -> tuple[str, str | None]:
    """Text of a page: a byte-order mark decides, then valid UTF-8 that is not plain ASCII, the transport's label, the label
    found in the first 1,024 bytes, else `decode`. UTF-16 labels in the page mean UTF-8; labels of unsafe encodings do not count."""
    if data.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
        return decode(data)
    try:
        text = data.decode("utf-8")
        if not text.isascii():
            return text, None
    except UnicodeDecodeError:
        pass
    found = re.search(rb"(?i)<meta[^>]*?charset\s*=\s*[\"']?\s*([a-z0-9_:.-]+)", re.sub(rb"<!--.*?-->", b"", data[:1024], flags=re.S))
    label = (declared or (found[1].decode() if found else "")).lower()
    label = {"x-user-defined": "cp1252", "iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "gb2312": "gb18030", "gbk": "gb18030"}.get(label, label)
    if not label or label in ("iso-2022-kr", "hz-gb-2312"):
        return decode(data)
    try:
        text = data.decode("utf-8" if label.startswith("utf-16") and not declared else label, "replace")
    except LookupError:
        return decode(data)
    return text, f"some bytes are not valid {label}" if "\ufffd" in text else None


def _frequent(c: str, encoding: str) -> bool:
    """First-level ideographs, kana, Hangul and East Asian punctuation, by the place they have in the encoding."""
    if 0x3000 <= ord(c) <= 0x30FF or 0xFF01 <= ord(c) <= 0xFF5E:
        return encoding != "big5" or ord(c) < 0x3040 or ord(c) > 0x30FF
    lead = c.encode(encoding, "replace")[0]
    return {
        "gb18030": 0xB0 <= lead <= 0xD7, "big5": 0xA4 <= lead <= 0xC6, "shift_jis": 0x88 <= lead <= 0x97,
        "euc_jp": 0xB0 <= lead <= 0xCF, "euc_kr": 0xB0 <= lead <= 0xC8,
    }[encoding]


def sniff_delimiter(text: str) -> str:
    """The delimiter whose first 50 records agree on the number of fields (four of five, two fields or more)."""
    best, found = (0.0, 0), ","
    for d in DELIMITERS:
        rows = [r for _, r in zip(range(50), csv.reader(io.StringIO(text[: 64 << 10]), delimiter=d)) if r]
        if not rows:
            continue
        counts = [len(r) for r in rows]
        mode = max(set(counts), key=lambda n: (counts.count(n), n))
        agree = counts.count(mode) / len(counts)
        pieces = [c.strip() for r in rows for c in r]
        decimal_comma = d == "," and mode > 1 and all(re.fullmatch(r"-?\d+", c) for c in pieces) and ";" in text[:4096]
        if mode > 1 and agree >= 0.8 and not decimal_comma and (agree, mode) > best:
            best, found = (agree, mode), d
    return found


def text_blocks(data: bytes) -> Iterator[tuple]:
    text, warning = decode(data)
    if warning:
        yield "warning", 0, warning
    yield from markdown_blocks(text)


def markdown_blocks(text: str) -> Iterator[tuple]:
    """Markdown as blocks; fences stay whole, everything else keeps its spelling."""
    fence, held = None, []
    for line in [*text.replace("\r\n", "\n").split("\n"), ""]:
        mark = re.match(r"^ {0,3}(`{3,}|~{3,})", line)
        if fence is None and mark:
            if held:
                yield "paragraph", 0, "\n".join(held)
            fence, held = mark[1], [line]
        elif fence is not None:
            held.append(line)
            if mark and mark[1].startswith(fence) and line.strip() == mark[1]:
                yield "paragraph", 0, "\n".join(held)
                fence, held = None, []
        elif (head := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line)) and not held:
            yield "heading", len(head[1]), head[2]
        elif line.strip():
            held.append(line.rstrip() + ("  " if line.endswith("  ") else ""))
        elif held:
            yield "paragraph", 0, "\n".join(held).rstrip()
            held = []
    if held:
        yield "paragraph", 0, "\n".join(held).rstrip()


def delimited_blocks(data: bytes) -> Iterator[tuple]:
    text, warning = decode(data)
    if warning:
        yield "warning", 0, warning
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=sniff_delimiter(text)):
        if row:
            yield "row", 1, "\x1f".join(row)


def json_blocks(data: bytes) -> Iterator[tuple]:
    yield "code", 0, json.dumps(json.loads(decode(data)[0]), indent=2, ensure_ascii=False)


def xml_blocks(data: bytes) -> Iterator[tuple]:
    """Elements as headings by depth, attributes as items, text as paragraphs. Document types and depths over 256 fail."""
    out, text, depth = [], [], 0

    def flush():
        if body := " ".join("".join(text).split()):
            out.append(("paragraph", 0, body))
        text.clear()

    def start(name, attrs):
        nonlocal depth
        flush()
        depth += 1
        if depth > 256:
            raise ValueError("elements nested deeper than 256")
        out.append(("heading", depth, name) if depth <= 6 else ("paragraph", 0, f"**{name}**"))
        out.extend(("item", 0, f"{k}: {v}") for k, v in attrs.items())

    def end(_):
        nonlocal depth
        flush()
        depth -= 1

    def doctype(*_):
        raise ValueError("document types are not read")

    parser = xml.parsers.expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    parser.StartDoctypeDeclHandler = doctype
    parser.Parse(data, True)
    yield from out


def clip(lines: list[str], head: int = 40, tail: int = 40, width: int = 500) -> list[str]:
    lines = [x if len(x) <= width else x[:width] + "…" for x in lines]
    return lines if len(lines) <= head + tail else [*lines[:head], f"[{len(lines) - head - tail} lines left out]", *lines[-tail:]]


def terminal_text(text: str) -> str:
    """Printed text without escape sequences, and with what a carriage return overwrote gone."""
    text = re.sub(r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07]*\x07|[@-_])", "", text).replace("\r\n", "\n")
    return "\n".join(line.rsplit("\r", 1)[-1] for line in text.split("\n"))


def notebook_blocks(data: bytes) -> Iterator[tuple]:
    book = json.loads(decode(data)[0])
    if title := (book.get("metadata") or {}).get("title"):
        yield "title", 0, title
    whole = lambda x: "".join(x) if isinstance(x, list) else x or ""
    for cell in book.get("cells", []):
        source = whole(cell.get("source"))
        if cell.get("cell_type") != "code":
            yield from markdown_blocks(source)
            continue
        if source.strip():
            yield "code", 0, source
        for o in cell.get("outputs", []):
            if o.get("output_type") == "error":
                yield "code", 0, "\n".join(clip(terminal_text("\n".join(o.get("traceback", []))).split("\n"), 6, 24))
                continue
            found = o.get("data") or {}
            if "text/markdown" in found:
                yield from markdown_blocks(whole(found["text/markdown"]))
            elif text := whole(o.get("text") or found.get("text/plain")):
                yield "code", 0, "\n".join(clip(terminal_text(text).rstrip("\n").split("\n")))
            if any(k.startswith("image/") for k in found):
                yield "warning", 0, "an output image is not embedded"


def rst_blocks(data: bytes) -> Iterator[tuple]:
    """reStructuredText: section titles by the order of their underlines, literals, lists, drawn tables, footnotes, replacements,
    simple directives and inline roles."""
    lines, levels, k, held = decode(data)[0].replace("\r\n", "\n").split("\n"), [], 0, []
    replaced = {m[1]: m[2] for line in lines if (m := re.match(r"^\.\. \|([^|]+)\| replace:: ?(.*)$", line))}
    tables, asked, defined = 0, 0, 0  # drawn so far; references and footnotes without a name

    def note(m):
        nonlocal asked
        asked += m[1] == "#"
        return references.mark(f"#{asked}" if m[1] == "#" else m[1].lstrip("#"), m[1].lstrip("#"), f"[{m[1]}]")

    def inline(x):
        x = re.sub(r"\|([^|\s](?:[^|]*[^|\s])?)\|", lambda m: replaced.get(m[1], m[0]), x)
        x = re.sub(r"\[(#?\w[\w.-]*|#|\*)\]_(?!\w)", note, x)
        x = re.sub(r"``(.+?)``", r"`\1`", x)
        x = re.sub(r"`([^`<]+?)\s*<([^>]+)>`__?", r"[\1](\2)", x)
        return re.sub(r":\w+:`([^`]+)`", r"`\1`", x)

    def flush():
        if held:
            yield "paragraph", 0, inline(" ".join(x.strip() for x in held))
            held.clear()

    while k < len(lines):
        line = lines[k]
        if (drawn := grids.is_grid(line)) or grids.is_simple(line):
            end = k + 1
            while end < len(lines) and (lines[end].strip() if drawn else not (grids.is_simple(lines[end]) and not "".join(lines[end + 1 : end + 2]).strip())):
                end += 1
            found = grids.grid(lines[k:end]) if drawn else grids.simple(lines[k : end + 1])
            if found:
                yield from flush()
                tables += 1
                yield from ((kind, level, "\x1f".join(inline(c) for c in text.split("\x1f"))) for kind, level, text in grids.blocks(*found, tables))
                k = end if drawn else end + 1
                continue
        if own := re.match(r"^\.\. \[(#?\w[\w.-]*|#|\*)\] ?(.*)$", line):
            yield from flush()
            body, k = [own[2]], k + 1
            while k < len(lines) and lines[k][:1].isspace() and lines[k].strip():
                body.append(lines[k].strip())
                k += 1
            defined += own[1] == "#"
            name = f"#{defined}" if own[1] == "#" else own[1].lstrip("#")
            yield "note", 0, references.note_text(name, "paragraph", 0, inline(" ".join(body).strip()))
            continue
        under = lines[k + 1] if k + 1 < len(lines) else ""
        if line.strip() and re.fullmatch(r"([=\-~^\"'`#*+.:_])\1{2,}", under.rstrip()) and len(under.rstrip()) >= len(line.strip()):
            yield from flush()
            if under[0] not in levels:
                levels.append(under[0])
            yield "heading", levels.index(under[0]) + 1, inline(line.strip())
            k += 2
            continue
        directive = re.match(r"^\.\. (\w[\w-]*)::\s*(.*)$", line)
        if directive or line.rstrip().endswith("::") and line.strip() != "::" or line.strip() == "::":
            if not directive and line.strip() != "::":
                held.append(line.rstrip()[:-1])
            yield from flush()
            k += 1
            body = []
            while k < len(lines) and (not lines[k].strip() or lines[k][:1].isspace()):
                body.append(lines[k])
                k += 1
            body = [x for x in body if not re.match(r"^\s+:\w[\w-]*:", x)]
            indent = min((len(x) - len(x.lstrip()) for x in body if x.strip()), default=0)
            text = "\n".join(x[indent:] for x in body).strip("\n")
            if directive and directive[1] in ("image", "figure"):
                yield "paragraph", 0, f"![]({directive[2]})"
            elif directive and directive[1] not in ("code", "code-block", "sourcecode"):
                yield "quote", 0, inline("\n".join(x for x in (f"[!{directive[1]}] {directive[2]}".strip(), text) if x))
            elif text:
                yield "code", 0, text
            continue
        if item := re.match(r"^(\s*)(?:[-*+]|\d+\.|#\.)\s+(.*)$", line):
            yield from flush()
            yield "item", len(item[1]) // 2, inline(item[2])
        elif line.startswith(".. "):
            yield from flush()
        elif line.strip():
            held.append(line)
        else:
            yield from flush()
        k += 1
    yield from flush()


def org_blocks(data: bytes) -> Iterator[tuple]:
    """Org: headings, keywords, blocks, lists, tables, footnotes, links and emphasis."""
    held, code, tables, in_table = [], None, 0, False

    def inline(x):
        x = re.sub(r"\[fn:([\w-]+)\]", lambda m: references.mark(f"fn:{m[1]}", m[1], m[0]), x)
        x = re.sub(r"\[\[([^\]]+)\]\[([^\]]+)\]\]", r"[\2](\1)", x)
        x = re.sub(r"\[\[([^\]]+)\]\]", r"<\1>", x)
        x = re.sub(r"(?<!\S)[=~](\S(?:.*?\S)?)[=~](?=[\s.,;:!?)]|$)", r"`\1`", x)
        x = re.sub(r"(?<!\S)\*(\S(?:[^*]*\S)?)\*(?=[\s.,;:!?)]|$)", r"**\1**", x)
        return re.sub(r"(?<!\S)/(\S(?:[^/]*\S)?)/(?=[\s.,;:!?)]|$)", r"*\1*", x)

    def flush():
        if held:
            yield "paragraph", 0, inline(" ".join(held))
            held.clear()

    for line in decode(data)[0].replace("\r\n", "\n").split("\n"):
        if code is not None:
            if re.match(r"(?i)^\s*#\+end_", line):
                yield "code" if code[0] != "quote" else "quote", 0, "\n".join(code[1])
                code = None
            else:
                code[1].append(line)
        elif begin := re.match(r"(?i)^\s*#\+begin_(\w+)", line):
            yield from flush()
            code = (begin[1].lower(), [])
        elif head := re.match(r"^(\*+)\s+(?:(?:TODO|DONE)\s+)?(.*?)(?:\s+:[\w:@]+:)?$", line):
            yield from flush()
            yield "heading", len(head[1]), inline(head[2])
        elif word := re.match(r"(?i)^\s*#\+(\w+):\s*(.*)$", line):
            yield from flush()
            if word[1].lower() == "title":
                yield "title", 0, word[2]
        elif line.lstrip().startswith("|"):
            yield from flush()
            tables += not in_table
            in_table = True
            if not re.match(r"^\s*\|[-+]+", line):
                yield "row", tables, "\x1f".join(inline(c.strip()) for c in line.strip().strip("|").split("|"))
            continue
        elif own := re.match(r"^\[fn:([\w-]+)\]\s+(.*)$", line):
            yield from flush()
            yield "note", 0, references.note_text(f"fn:{own[1]}", "paragraph", 0, inline(own[2]))
        elif item := re.match(r"^(\s*)(?:[-+]|\d+[.)])\s+(.*)$", line):
            yield from flush()
            yield "item", len(item[1]) // 2, inline(item[2])
        elif line.strip() and not line.lstrip().startswith("# "):
            held.append(line.strip())
        else:
            yield from flush()
        in_table = False
    yield from flush()


def tex_blocks(data: bytes) -> Iterator[tuple]:
    """LaTeX: the body's sections, styles, lists, verbatim, tables; math stays as written; comments go."""
    text = decode(data)[0].replace("\r\n", "\n")
    if title := re.search(r"\\title\{([^{}]*)\}", text):
        yield "title", 0, title[1]
    body = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|$)", text, re.S)
    text = re.sub(r"(?<!\\)%.*", "", body[1] if body else text)

    def inline(x):
        for name, mark in (("textbf", "**"), ("emph", "*"), ("textit", "*"), ("texttt", "`")):
            x = re.sub(rf"\\{name}\{{([^{{}}]*)\}}", rf"{mark}\1{mark}", x)
        x = re.sub(r"\\href\{([^{}]*)\}\{([^{}]*)\}", r"[\2](\1)", x)
        x = re.sub(r"\\url\{([^{}]*)\}", r"<\1>", x)
        x = re.sub(r"\\(?:label|cite|ref|maketitle|noindent)\b(?:\{[^{}]*\})?", "", x)
        x = x.replace("``", "\u201c").replace("''", "\u201d").replace("~", " ").replace("---", "\u2014").replace("--", "\u2013")
        return " ".join(re.sub(r"\\([%&$#_{}])", r"\1", x).split())

    heads = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
    pattern = r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}|\\begin\{(verbatim|lstlisting|itemize|enumerate|tabular|equation\*?|quote)\}(.*?)\\end\{\3\}|\n\s*\n"
    at = 0
    for m in [*re.finditer(pattern, text, re.S), None]:
        if plain := inline(text[at : m.start() if m else len(text)]):
            yield "paragraph", 0, plain
        if m is None:
            return
        at, kind, inner = m.end(), m[3], m[4]
        if m[1]:
            yield "heading", heads[m[1]], inline(m[2])
        elif kind in ("verbatim", "lstlisting"):
            yield "code", 0, inner.strip("\n")
        elif kind in ("itemize", "enumerate"):
            for item in re.split(r"\\item\b", inner)[1:]:
                yield "item", 0, inline(item)
        elif kind == "tabular":
            for row in re.split(r"\\\\", re.sub(r"^\s*\{[^{}]*\}|\\hline", "", inner)):
                if row.strip():
                    yield "row", 1, "\x1f".join(inline(c) for c in re.split(r"(?<!\\)&", row))
        elif kind == "quote":
            yield "quote", 0, inline(inner)
        elif kind:
            yield "paragraph", 0, f"$$\n{inner.strip()}\n$$"
