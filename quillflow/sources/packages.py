"""Mail and packaged documents as blocks: EML, DOCX, XLSX, PPTX, OpenDocument and EPUB, on the standard library."""

from __future__ import annotations

import email
import email.policy
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from ..functions.escaping import styled
from .html import page_blocks
from .plain import markdown_blocks
from .references import mark, note_text

#: Bounds of untrusted packages: bytes of a part, parts, cells of a sheet.
PART_BYTES, PARTS, CELLS = 128 << 20, 4096, 4 << 20


class Package:
    """A bounded ZIP: parts by name, XML with local names, relationships that stay inside."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        if len(self.zip.infolist()) > PARTS:
            raise ValueError(f"more than {PARTS} parts")
        self.names = {i.filename for i in self.zip.infolist()}

    def read(self, name: str) -> bytes:
        if self.zip.getinfo(name).file_size > PART_BYTES:
            raise ValueError(f"{name} is larger than {PART_BYTES >> 20} MiB")
        return self.zip.read(name)

    def xml(self, name: str):
        data = self.read(name)
        if b"<!DOCTYPE" in data[:4096]:
            raise ValueError("document types are not read")
        root = ElementTree.fromstring(data)
        for e in root.iter():
            e.tag = e.tag.rsplit("}", 1)[-1]
            e.attrib = {k.rsplit("}", 1)[-1]: v for k, v in e.attrib.items()}
        return root

    def links(self, part: str) -> dict[str, str]:
        folder, name = posixpath.split(part)
        rels = f"{folder}/_rels/{name}.rels".lstrip("/")
        if rels not in self.names:
            return {}
        out = {}
        for r in self.xml(rels):
            target = r.get("Target", "")
            out[r.get("Id")] = target if r.get("TargetMode") == "External" else posixpath.normpath(posixpath.join(folder, target)) if target[:1] != "/" else target[1:]
        return out


def _styled(p, links, link: str = "") -> Iterator[tuple]:
    """Runs of a paragraph of WordprocessingML: (text, styles, link), and finished Markdown of marks and images (styles None)."""
    for e in p:
        if e.tag == "hyperlink":
            yield from _styled(e, links, links.get(e.get("id"), link))
        elif e.tag in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple"):
            yield from _styled(e, links, link)
        elif e.tag == "r":
            on = lambda *names: any((x := e.find(f"rPr/{n}")) is not None and x.get("val") not in ("0", "false") for n in names)  # noqa: B023, E731
            styles = frozenset(s for s, names in (("strong", "b"), ("em", "i")) if on(names)) | (frozenset(["del"]) if on("strike", "dstrike") else frozenset())
            for c in e:
                if c.tag in ("footnoteReference", "endnoteReference"):
                    yield mark(c.tag[:1] + c.get("id", ""), c.get("id", ""), ""), None, ""
                elif c.tag in ("drawing", "pict") and (blip := next((x for x in c.iter() if x.tag in ("blip", "imagedata")), None)) is not None:
                    about = next((x.get("descr") or "" for x in c.iter("docPr")), "")
                    yield f"![{re.sub(r'[][()]', '_', ' '.join(about.split()))}](cid:{blip.get('embed') or blip.get('id')})", None, ""
                elif text := {"t": c.text or "", "tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}.get(c.tag, ""):
                    yield text, styles, link


def _runs(p, links, place: str = "paragraph") -> str:
    """Text of a paragraph of WordprocessingML as Markdown: styles, links, breaks, references and images; plain text is
    escaped where it would be read as a mark."""
    return _joined(_styled(p, links), place)


def _joined(runs, place: str) -> str:
    out, held = [], []
    for text, styles, link in [*runs, ("", None, "")]:
        if styles is None:
            if held:
                out.append(styled(held, place if not out else "cell" if place == "cell" else "rest"))
            out.append(text)
            held = []
        else:
            held.append((text, styles, link))
    return "".join(out).replace("\n", "  \n")


def docx_blocks(data: bytes) -> Iterator[tuple]:
    z = Package(data)
    links = z.links("word/document.xml")
    if "docProps/core.xml" in z.names and (t := z.xml("docProps/core.xml").find("title")) is not None and t.text:
        yield "title", 0, t.text
    styles = {}
    if "word/styles.xml" in z.names:
        for s in z.xml("word/styles.xml").iter("style"):
            name = s.find("name")
            styles[s.get("styleId")] = (name.get("val") if name is not None else "").lower()
    tables = 0
    for e in z.xml("word/document.xml").find("body"):
        if e.tag == "p":
            text = _runs(e, links).strip()
            if not text:
                continue
            style = e.find("pPr/pStyle")
            name = styles.get(style.get("val"), style.get("val").lower()) if style is not None else ""
            number = e.find("pPr/numPr")
            if name == "title" or re.match(r"heading\s*\d", name):
                plain = [(t, s and s - {"strong"}, link) if s is not None else (t, s, link) for t, s, link in _styled(e, links)]
                yield "heading", 1 if name == "title" else int(re.search(r"\d", name)[0]), _joined(plain, "heading").strip().replace("\n", " ")
            elif number is not None or name.startswith("list"):
                level = number.find("ilvl") if number is not None else None
                yield "item", int(level.get("val")) if level is not None else 0, text
            elif "quote" in name:
                yield "quote", 0, text
            else:
                yield "paragraph", 0, text
        elif e.tag == "tbl":
            tables += 1
            for row in e.iter("tr"):
                yield "row", tables, "\x1f".join("\n".join(_runs(p, links, "rest").strip().replace("  \n", "\n") for p in c.iter("p")) for c in row.findall("tc"))
    for note in ("footnotes", "endnotes"):
        if f"word/{note}.xml" in z.names:
            for n in z.xml(f"word/{note}.xml"):
                for p in n.iter("p") if n.get("type") is None else ():
                    if text := _runs(p, {}).strip():
                        yield "note", 0, note_text(note[0] + n.get("id", ""), "paragraph", 0, text)
    yield from (("asset", 0, f"{k}\x1f{posixpath.basename(v)}") for k, v in links.items() if v in z.names and "/media/" in v)


def _serial(value: float) -> str:
    at = datetime(1899, 12, 30) + timedelta(days=value)
    return at.date().isoformat() if value == int(value) else at.replace(microsecond=0).isoformat(" ")


def xlsx_blocks(data: bytes) -> Iterator[tuple]:
    """Sheets as tables: shared strings, dates by number format, booleans, hidden rows left out with a warning."""
    z = Package(data)
    links = z.links("xl/workbook.xml")
    shared = ["".join(t.text or "" for t in si.iter("t")) for si in z.xml("xl/sharedStrings.xml").iter("si")] if "xl/sharedStrings.xml" in z.names else []
    dates = set()
    if "xl/styles.xml" in z.names:
        styles = z.xml("xl/styles.xml")
        own = {f.get("numFmtId"): f.get("formatCode", "") for f in styles.iter("numFmt")}
        xfs = styles.find("cellXfs")
        for k, xf in enumerate(xfs if xfs is not None else []):
            n = xf.get("numFmtId", "0")
            if 14 <= int(n) <= 22 or re.search(r"[dmyh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")).lower()):
                dates.add(str(k))
    cells = hidden = formulas = 0
    for number, sheet in enumerate(z.xml("xl/workbook.xml").iter("sheet"), 1):
        if sheet.get("state") in ("hidden", "veryHidden"):
            yield "warning", 0, f"hidden sheet {sheet.get('name')} is left out"
            continue
        yield "heading", 2, sheet.get("name")
        for row in z.xml(links[sheet.get("id")]).iter("row"):
            if row.get("hidden") == "1":
                hidden += 1
                continue
            out: list[str] = []
            for c in row.findall("c"):
                column = 0
                for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    column = column * 26 + ord(ch) - 64
                v, kind = c.findtext("v"), c.get("t")
                if kind == "s":
                    v = shared[int(v)] if v else ""
                elif kind == "inlineStr":
                    v = "".join(t.text or "" for t in c.iter("t"))
                elif kind == "b":
                    v = "TRUE" if v == "1" else "FALSE"
                elif v is None and (f := c.find("f")) is not None and f.text:
                    v, formulas = f"`={f.text}`", formulas + 1
                elif v and kind in (None, "n"):
                    v = _serial(float(v)) if c.get("s") in dates else str(int(float(v))) if float(v) == int(float(v)) and abs(float(v)) < 1e15 else v
                out += [""] * (max(column, len(out) + 1) - 1 - len(out)) + [v or ""]
            cells += len(out)
            if cells > CELLS:
                raise ValueError(f"more than {CELLS} cells")
            if any(out):
                yield "row", number, "\x1f".join(out)
    if hidden:
        yield "warning", 0, f"{hidden} hidden rows are left out"
    if formulas:
        yield "warning", 0, f"{formulas} formulas have no saved value"


def pptx_blocks(data: bytes) -> Iterator[tuple]:
    z = Package(data)
    links = z.links("ppt/presentation.xml")
    tables = 0
    for number, s in enumerate(z.xml("ppt/presentation.xml").iter("sldId"), 1):
        part = links[s.get("id")]
        slide = z.xml(part)
        yield "paragraph", 0, f"<!-- Slide number: {number} -->"
        if slide.get("show") == "0":
            yield "paragraph", 0, "<!-- hidden slide -->"
        for shape in slide.iter():
            if shape.tag == "sp":
                place = shape.find("nvSpPr/nvPr/ph")
                kind = place.get("type", "body") if place is not None else ""
                for p in shape.iter("p"):
                    text = "".join(t.text or "" if t.tag == "t" else "\n" for t in p.iter() if t.tag in ("t", "br")).strip()
                    if not text:
                        continue
                    level = p.find("pPr")
                    if kind in ("title", "ctrTitle"):
                        yield "heading", 2, text.replace("\n", " ")
                    elif place is not None and kind in ("body", "obj"):
                        yield "item", int(level.get("lvl", 0)) if level is not None else 0, text.replace("\n", " ")
                    else:
                        yield "paragraph", 0, text
            elif shape.tag == "tbl":
                tables += 1
                for row in shape.iter("tr"):
                    yield "row", tables, "\x1f".join("".join(t.text or "" for t in c.iter("t")) for c in row.findall("tc"))
        for target in z.links(part).values():
            if "notesSlide" in target and target in z.names:
                notes = [" ".join(t.text or "" for t in p.iter("t")) for sp in z.xml(target).iter("sp") if (ph := sp.find("nvSpPr/nvPr/ph")) is not None and ph.get("type") == "body" for p in sp.iter("p")]
                if text := "\n".join(x for x in notes if x.strip()):
                    yield "quote", 0, f"Notes: {text}"


def odf_blocks(data: bytes) -> Iterator[tuple]:
    """Text documents and sheets of OpenDocument; repeated cells are written out, empty tails are not."""
    z = Package(data)
    body = z.xml("content.xml").find("body")

    def flat(e) -> str:
        out = [e.text or ""]
        for c in e:
            if c.tag == "a":
                out.append(f"[{flat(c)}]({c.get('href', '')})")
            elif c.tag == "s":
                out.append(" " * int(c.get("c", 1)))
            elif c.tag in ("tab", "line-break"):
                out.append("\t" if c.tag == "tab" else "  \n")
            elif c.tag not in ("note", "annotation"):
                out.append(flat(c))
            out.append(c.tail or "")
        return "".join(out)

    tables = 0

    def walk(e, depth):
        nonlocal tables
        for c in e:
            if c.tag == "h":
                yield "heading", int(c.get("outline-level", 1)), flat(c).strip()
            elif c.tag == "p" and flat(c).strip():
                yield ("item", depth - 1, flat(c).strip()) if depth else ("paragraph", 0, flat(c).strip())
            elif c.tag == "list":
                yield from walk(c, depth + 1)
            elif c.tag == "table":
                tables += 1
                if c.get("name") and body.find("spreadsheet") is not None:
                    yield "heading", 2, c.get("name")
                for row in c.iter("table-row"):
                    cells = []
                    for x in row:
                        if x.tag in ("table-cell", "covered-table-cell"):
                            text = "\n".join(flat(p) for p in x.iter("p"))
                            cells += [text] * min(int(x.get("number-columns-repeated", 1)), 1024 if text else 64)
                    while cells and not cells[-1]:
                        cells.pop()
                    if cells:
                        yield "row", tables, "\x1f".join(cells)
            elif c.tag not in ("annotation", "tracked-changes"):
                yield from walk(c, depth)

    yield from walk(body, 0)


def epub_blocks(data: bytes) -> Iterator[tuple]:
    """Spine documents in order, after the package's title, authors, language and other facts."""
    z = Package(data)
    path = z.xml("META-INF/container.xml").find(".//rootfile").get("full-path")
    package, folder = z.xml(path), posixpath.dirname(path)
    for name in ("title", "creator", "language", "publisher", "date", "description", "identifier"):
        for e in package.iter(name):
            if e.text:
                yield ("title", 0, e.text) if name == "title" else ("meta", 0, f"{name}\x1f{e.text}")
    items = {i.get("id"): i.get("href") for i in package.iter("item")}
    for ref in package.iter("itemref"):
        part = posixpath.normpath(posixpath.join(folder, items.get(ref.get("idref"), "")))
        if part in z.names:
            for kind, level, text in page_blocks(z.read(part).decode("utf-8", "replace"), None):
                if kind not in ("title", "meta", "chrome"):
                    yield kind, level % 100, text
        else:
            yield "warning", 0, f"{ref.get('idref')} is missing"


def eml_blocks(data: bytes) -> Iterator[tuple]:
    """A message: subject, header block, the best body (HTML before text), attachments as a list, nested messages one level."""
    yield from _message(email.message_from_bytes(data, policy=email.policy.default), 0)


def _message(m, depth: int) -> Iterator[tuple]:
    if subject := str(m.get("subject", "")).strip():
        if not depth:
            yield "title", 0, subject
        yield "heading", 1 + depth, subject
    for name in ("From", "To", "Cc", "Date"):
        if m.get(name):
            yield "item", 0, f"**{name}:** " + re.sub(r"([\[\]<>])", r"\\\1", str(m[name]))
    body = m.get_body(("html", "plain"))
    if body is not None:
        text = body.get_content()
        if body.get_content_type() == "text/html":
            yield from ((k, level % 100, t) for k, level, t in page_blocks(text, None) if k not in ("title", "meta"))
        else:
            yield from markdown_blocks(text)
    for part in m.walk():  # parts that an image of the body may name
        if cid := str(part.get("Content-ID", "")).strip().strip("<>"):
            yield "asset", 0, f"{cid}\x1f{part.get_filename() or cid}"
    names = []
    for k, part in enumerate(m.iter_attachments()):
        if part.get_content_type() == "message/rfc822" and depth == 0:
            yield from _message(part.get_content(), 1)
            continue
        size = len(part.get_payload(decode=True) or b"")
        names.append(f"{part.get_filename() or f'attachment-{k}'} ({size} B)")
    if names:
        yield "heading", 2 + depth, "Attachments"
        yield from (("item", 0, n) for n in names)
