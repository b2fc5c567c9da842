"""Files: scan, checks, content sniffing, dispatch to readers, and conversion to Markdown."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.routing import READERS, with_reader
from . import blocks as B, packages, plain
from .html import page_blocks

MAX_BYTES = 500 << 20
#: Path segments that a scan passes over: hidden ones, editors' locks, dependency folders.
SKIPPED = "(^|/)(\\.[^/]*|~\\$[^/]*|node_modules)(/|$)"


def _html(data: bytes) -> Iterator[tuple]:
    text, warning = plain.decode_html(data)
    if warning:
        yield "warning", 0, warning
    yield from ((k, level % 100, t) for k, level, t in page_blocks(text, None) if k != "chrome")


BY_READER = {
    "text": plain.text_blocks, "html": _html, "delimited": plain.delimited_blocks, "json": plain.json_blocks, "xml": plain.xml_blocks,
    "notebook": plain.notebook_blocks, "rst": plain.rst_blocks, "org": plain.org_blocks, "tex": plain.tex_blocks, "mail": packages.eml_blocks,
    "word": packages.docx_blocks, "sheet": packages.xlsx_blocks, "slides": packages.pptx_blocks, "opendocument": packages.odf_blocks, "epub": packages.epub_blocks,
}


def scan(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path, length, content, reader of the files below a folder. Names are filtered before contents are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)
    inner = F.regexp_replace("path", "^file:/*", "/")
    kept = files.filter(~F.regexp_replace(inner, f"^{root.rstrip('/')}/", "").rlike(SKIPPED))
    return with_reader(kept.select("path", "length", "content"), "path")


def checked(files: DataFrame) -> DataFrame:
    """Adds `problem`: empty, too large, or of no known format; null where the file can be read."""
    none = F.when(F.col("length") == 0, "the file is empty").when(F.col("length") > MAX_BYTES, "the file is larger than 500 MiB")
    return files.withColumn("problem", none.when(F.col("reader").isNull(), "no reader for this extension"))


def sniffed(content: Column, reader: Column) -> Column:
    """The reader that the first bytes call for, where they contradict the name."""
    head = F.hex(F.substring(content, 1, 1024))
    pdf, zip_ = head.contains("255044462D"), head.startswith("504B0304")
    zipped = ("word", "sheet", "slides", "opendocument", "epub", "numbers")
    return F.when(pdf, "pdf").when(zip_ & ~reader.isin(*zipped), "zip").when(~zip_ & reader.isin("epub", "numbers"), "text").otherwise(reader)


def zip_reader(data: bytes) -> str:
    """Which packaged format a ZIP is, by its part names."""
    names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
    for part, reader in (("word/document.xml", "word"), ("xl/workbook.xml", "sheet"), ("ppt/presentation.xml", "slides"), ("META-INF/container.xml", "epub"), ("content.xml", "opendocument")):
        if part in names:
            return reader
    raise ValueError("a ZIP of no known format")


def _read(data: bytes, reader: str) -> Iterator[tuple]:
    if reader == "zip":
        reader = zip_reader(data)
        yield "warning", 0, f"the content is a {reader} file; rename it"
    if reader not in BY_READER:
        raise ValueError(f"files of the {reader} reader need a renderer that is not part of this build")
    yield from BY_READER[reader](bytes(data))


def convert(files: DataFrame) -> DataFrame:
    """path, markdown, title, word_count, warnings, error of each file: one row per file, whatever is wrong with it."""
    ready = checked(files)
    sound = ready.filter("problem is null").withColumn("reader", sniffed(F.col("content"), F.col("reader")))
    docs = B.assemble(B.without_repeats(B.read(sound, "path", "content", _read, "reader"))).withColumnRenamed("key", "path")
    stem = F.regexp_extract("path", "([^/]+?)(\\.[^./]*)?$", 1)
    whole = F.regexp_extract("path", "([^/]+)$", 1)
    named = F.when(F.lower("path").rlike("\\.(csv|tsv|xml)$"), whole).otherwise(F.coalesce("title", stem))
    docs = docs.withColumn("title", named)
    bad = ready.filter("problem is not null")
    empty = F.array().cast("array<string>")
    failed = bad.select("path", F.lit("").alias("markdown"), stem.alias("title"), F.lit(0).cast("long").alias("word_count"), empty.alias("warnings"), F.col("problem").alias("error"))
    return docs.unionByName(failed)


assert set(BY_READER) <= set(READERS)
