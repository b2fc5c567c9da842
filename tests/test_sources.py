import io
import json
import zipfile
from email.message import EmailMessage

from quillflow.sources import blocks as B, files, html, packages, plain


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = package({
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>'
    "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t> plain</w:t></w:r></w:p>"
    "<w:p><w:pPr><w:numPr><w:ilvl w:val='1'/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b|c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
})
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = package({
    "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="S" r:id="r1"/><sheet name="X" state="hidden" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
    "xl/worksheets/s.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row><c r="A2" s="1"><v>45292</v></c><c r="B2"><f>A1+1</f></c></row>'
    '<row hidden="1"><c r="A3"><v>1</v></c></row></sheetData></worksheet>',
})


def test_docx():
    assert list(packages.docx_blocks(DOCX)) == [("heading", 1, "Head"), ("paragraph", 0, "**bold** plain"), ("item", 1, "item"), ("row", 1, "a\x1fb|c")]


def test_xlsx():
    found = list(packages.xlsx_blocks(XLSX))
    assert ("row", 1, "name\x1f\x1f2.5") in found and ("row", 1, "2024-01-01\x1f`=A1+1`") in found
    assert [t for k, _, t in found if k == "warning"] == ["hidden sheet X is left out", "1 hidden rows are left out", "1 formulas have no saved value"]


def test_pptx_and_odt_and_epub():
    pptx = package({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" {R}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/s1.xml"/></Relationships>',
        "ppt/slides/s1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><a:p><a:t>T</a:t></a:p></p:sp>'
        '<p:sp><p:nvSpPr><p:nvPr><p:ph/></p:nvPr></p:nvSpPr><a:p><a:pPr lvl="1"/><a:t>x</a:t></a:p></p:sp></p:sld>',
    })
    assert list(packages.pptx_blocks(pptx))[1:] == [("heading", 2, "T"), ("item", 1, "x")]
    odt = package({"content.xml": '<o:d xmlns:o="o" xmlns:t="t"><o:body><o:text><t:h t:outline-level="2">H</t:h><t:p>a<t:s t:c="2"/>b</t:p><t:list><t:list-item><t:p>i</t:p></t:list-item></t:list></o:text></o:body></o:d>'})
    assert list(packages.odf_blocks(odt)) == [("heading", 2, "H"), ("paragraph", 0, "a  b"), ("item", 0, "i")]
    epub = package({
        "META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>',
        "o/p.opf": '<p><title>Book</title><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="z"/></spine></p>',
        "o/a.xhtml": "<html><body><h1>One</h1><p>Text</p></body></html>",
    })
    assert list(packages.epub_blocks(epub)) == [("title", 0, "Book"), ("heading", 1, "One"), ("paragraph", 0, "Text"), ("warning", 0, "z is missing")]


def test_mail():
    m = EmailMessage()
    m["Subject"], m["From"] = "Hi", "a@b.c"
    m.set_content("plain body")
    m.add_alternative("<p>html <b>body</b></p>", subtype="html")
    m.add_attachment(b"123", maintype="application", subtype="x", filename="f.bin")
    found = list(packages.eml_blocks(m.as_bytes()))
    assert ("title", 0, "Hi") in found and ("paragraph", 0, "html **body**") in found and ("item", 0, "f.bin (3 B)") in found


def test_delimiters_and_encodings():
    for d in ",;\t|":
        assert plain.sniff_delimiter(f"a{d}b\n1{d}2\n3{d}4\n") == d
    for name, text in (("gb18030", "中文字数统计和英文混合的文本，这是一个测试。"), ("shift_jis", "日本語のテキストです。これはテストです"), ("cp1252", "naïve café – déjà vu"), ("utf-16", "abc")):
        assert plain.decode(text.encode(name))[0] == text


def test_page_encodings():
    head = '<meta charset="{}"><p>{}</p>'
    assert "naïve" in plain.decode_html(head.format("iso-8859-1", "naïve").encode("cp1252"))[0]
    assert "中文" in plain.decode_html(head.format("gb2312", "中文").encode("gb18030"))[0]
    assert "é" in plain.decode_html(head.format("windows-1252", "é").encode())[0]
    assert plain.decode_html(b'<meta charset="euc-jp">\xff\xff')[1] == "some bytes are not valid euc-jp"


def test_notebook_clipping():
    book = {"cells": [{"cell_type": "code", "source": ["print()"], "outputs": [{"output_type": "stream", "text": "\n".join(map(str, range(200)))}]}]}
    found = list(plain.notebook_blocks(json.dumps(book).encode()))
    assert found[0] == ("code", 0, "print()") and "[120 lines left out]" in found[1][2]
    assert plain.terminal_text("\x1b[31mred\x1b[0m\r\n10%\r99%") == "red\n99%"


def test_html_structure():
    page = (
        "<title>T</title><style>p{}</style><script>var a='</p>';</script><nav><a href='/x'>nav</a></nav><article><h1>H</h1><p><b>bold<br><p>next</b> one"
        "<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><th>x<th>y<tr><td>1<td>2</table><pre> code\n  x</pre><p hidden>no</p></article><footer>foot</footer>"
    )
    found = [b for b in html.page_blocks(page, "http://e.com/d/") if b[0] != "chrome"]
    assert ("title", 0, "T") in found and ("heading", 101, "H") in found and ("paragraph", 100, "next one") in found
    assert [(k, level % 100, t) for k, level, t in found if k in ("item", "row", "code")] == [
        ("item", 0, "a"), ("item", 0, "b"), ("item", 1, "c"), ("row", 1, "x\x1fy"), ("row", 1, "1\x1f2"), ("code", 0, " code\n  x"),
    ]
    assert not any("no" == t or "var" in t for _, _, t in found)


def test_pages_to_markdown(spark):
    long = "A paragraph that is long enough to count as a repeated block."
    body = f"<nav>menu</nav><article><h1>Head</h1><p>{long}</p><p>{long}</p><table><tr><td>a</td></tr><tr><td>1</td><td>2</td></tr></table></article>"
    rows = [(1, "http://e.com", body), (2, "http://e.com", None), (3, "http://e.com", "<nav>only menu</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    docs = {r["key"]: r for r in B.assemble(B.without_repeats(html.extract(pages))).collect()}
    assert docs["1"]["markdown"] == f"# Head\n\n{long}\n\n| a |  |\n| --- | --- |\n| 1 | 2 |\n" and docs["1"]["title"] == "Head"
    assert "2" not in docs and ("3" not in docs or docs["3"]["error"])


def test_files_end_to_end(spark, tmp_path):
    for name, data in {
        "a.docx": DOCX, "b.xlsx": XLSX, "c.csv": b"n,v\n1,2\n", "d.json": b'{"a":1}', "e.xml": b"<a>t</a>", "f.md": b"# M\n\ntext", "g.html": b"<h1>G</h1><p>x</p>",
        "i.zzz": b"?", "j.json": b"{broken", "k.epub": b"plain text", "sub/l.txt": DOCX, ".hidden/m.txt": b"x", "~$n.docx": b"x",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    docs = {r["path"].split("/")[-1]: r for r in files.convert(files.scan(spark, str(tmp_path))).collect()}
    assert set(docs) == {"a.docx", "b.xlsx", "c.csv", "d.json", "e.xml", "f.md", "g.html", "i.zzz", "j.json", "k.epub", "l.txt"}
    assert docs["c.csv"]["markdown"] == "| n | v |\n| --- | --- |\n| 1 | 2 |\n" and docs["c.csv"]["title"] == "c.csv"
    assert docs["d.json"]["markdown"] == '```\n{\n  "a": 1\n}\n```\n' and docs["a.docx"]["title"] == "Head"
    none = spark.createDataFrame([("h.txt", 0, b"", "text")], "path string, length long, content binary, reader string")
    assert files.convert(none).first()["error"] == "the file is empty"
    assert "JSON" in docs["j.json"]["error"] and docs["i.zzz"]["error"]
    assert docs["l.txt"]["warnings"] == ["the content is a word file; rename it"] and docs["f.md"]["markdown"] == "# M\n\ntext\n"
