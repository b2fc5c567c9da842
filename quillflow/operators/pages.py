"""Operators over lines and blocks of paged or long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

STRUCTURE = "^[#!\\[\\-*|>`~<]"


def page_lines(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """book, page, pos, line: the trimmed lines of each page that are not empty."""
    lines = pages.select(F.col(book).alias("book"), F.col(page).alias("page"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    return lines.withColumn("line", F.trim(F.translate("raw", "\t\r", "  "))).filter("line <> ''")


def repeated_footers(pages: DataFrame, book: str, page: str, text: str, share: int = 2) -> DataFrame:
    """book, line, pages, of_pages: short lines among the last four of at least 1/share of a book's pages (three at least).

    Lines of digits and Markdown structure do not count. Only the last four lines of each page are shuffled by line.
    """
    last = Window.partitionBy("book", "page").orderBy(F.desc("pos"))
    ranked = page_lines(pages, book, page, text).withColumn("from_end", F.row_number().over(last))
    sized = ranked.withColumn("n", F.count("*").over(Window.partitionBy("book", "page")))
    ends = sized.filter("from_end <= 4 and n >= 2").filter((F.length("line") < 30) & ~F.col("line").rlike(STRUCTURE))
    per_book = ends.groupBy("book").agg(F.count_distinct("page").alias("of_pages"))
    counts = ends.groupBy("book", "line").agg(F.count("*").alias("pages"))
    both = counts.join(per_book, "book").filter("of_pages >= 3").filter(F.col("pages") * share >= F.col("of_pages"))
    return both.filter(~F.col("line").rlike("^\\p{N}+$")).select("book", "line", "pages", "of_pages")


def without_footers(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """The pages' texts less the lines that `repeated_footers` finds, and less page numbers one or two lines below them."""
    common = repeated_footers(pages, book, page, text).select(F.col("book").alias("__book"), F.col("line").alias("__line"), F.lit(True).alias("__common"))
    lines = pages.select(F.col(book).alias("__b"), F.col(page).alias("__p"), F.posexplode(F.split(F.col(text), "\n")).alias("__pos", "__raw"))
    plain = F.trim(F.translate("__raw", "\t\r", "  "))
    marked = lines.join(common, (F.col("__b") == F.col("__book")) & (plain == F.col("__line")), "left")
    order = Window.partitionBy("__b", "__p").orderBy("__pos")
    before = F.coalesce(F.lag("__common", 1).over(order), F.lag("__common", 2).over(order), F.lit(False))
    gone = F.coalesce("__common", F.lit(False)) | (plain.rlike("^\\p{N}+$") & before)
    kept = marked.withColumn("__gone", gone).filter("not __gone").groupBy("__b", "__p").agg(F.array_sort(F.collect_list(F.struct("__pos", "__raw"))).alias("__kept"))
    joined = pages.join(kept, (F.col(book) == F.col("__b")) & (F.col(page) == F.col("__p")), "left")
    whole = F.array_join(F.transform("__kept", lambda s: s["__raw"]), "\n")
    return joined.withColumn(text, F.when(F.col(text).isNotNull(), F.coalesce(whole, F.lit("")))).select(*pages.columns)


def repeated_blocks(docs: DataFrame, key: str, text: str, least: int = 30) -> DataFrame:
    """key, pos, block: blocks of `least` characters or more that equal the block before them."""
    blocks = docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n+")).alias("pos", "block"))
    blocks = blocks.filter(F.trim("block") != "")
    before = F.lag("block").over(Window.partitionBy("key").orderBy("pos"))
    return blocks.withColumn("before", before).filter((F.col("block") == F.col("before")) & (F.length("block") >= least)).select("key", "pos", "block")


def repeated_tails(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, unit, copies: texts that end in one line over and over, blank lines between copies aside.

    Prose counts from 6 copies with 120 visible weight (a non-ASCII character weighs two), table rows and rules from 64
    copies with 1024. The last run is found with an island number from the end, so no text is walked in Python.
    """
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", F.regexp_replace("raw", "\\s+$", "")).filter("line <> ''")
    back = Window.partitionBy("key").orderBy(F.desc("pos"))
    changed = (F.col("line") != F.coalesce(F.lag("line").over(back), F.col("line"))).cast("int")
    runs = lines.withColumn("changed", changed).withColumn("island", F.sum("changed").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    last = runs.filter("island = 0").groupBy("key").agg(F.max("line").alias("unit"), F.count("*").alias("copies"))
    solid = F.regexp_replace("unit", "\\s", "")
    weight = F.length(solid) * 2 - F.length(F.regexp_replace(solid, "[^\\x00-\\x7F]", ""))
    letters = F.length(F.regexp_replace(solid, "[^\\p{L}\\p{N}]", ""))
    structural = F.ltrim("unit").startswith("|") | (letters * 2 < F.length(solid))
    least, heavy = F.when(structural, 64).otherwise(6), F.when(structural, 1024).otherwise(120)
    return last.filter((F.length(solid) > 0) & (F.col("copies") >= least) & (F.col("copies") * weight >= heavy))


def table_warnings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, cells, expected: pipe-table rows whose number of cells differs from their table's first row."""
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", F.trim("raw")).withColumn("row", F.col("line").startswith("|"))
    order = Window.partitionBy("key").orderBy("pos")
    starts = (F.col("row") & ~F.coalesce(F.lag("row").over(order), F.lit(False))).cast("int")
    tables = lines.withColumn("starts", starts).withColumn("table", F.sum("starts").over(order)).filter("row")
    inner = F.regexp_replace(F.regexp_replace("line", "\\\\\\|", "x"), "^\\||\\|$", "")
    cells = F.size(F.split(inner, "\\|"))
    first = Window.partitionBy("key", "table").orderBy("pos")
    sized = tables.withColumn("cells", cells).withColumn("expected", F.first("cells").over(first))
    return sized.filter("cells <> expected").select("key", "pos", "cells", "expected")


def header_text(page: Column) -> Column:
    """What a page's first block says if it may be a running header: one plain line of 8 to 160 characters, its emphasis and
    the page number at either end aside; null otherwise."""
    block = F.trim(F.element_at(F.split(F.regexp_replace(page, "^\\s+", ""), "\n\n", 2), 1))
    structure = block.rlike("\n|^[#|>`!<\\[]|^[-*+] |^[0-9]+[.)]")
    plain = F.trim(F.regexp_replace(F.regexp_replace(block, "\\*|</?u>|\\\\", ""), "\\s+", " "))
    core = F.regexp_replace(plain, "^[0-9\\s|·•–—/-]+|[0-9\\s|·•–—/-]+$", "")
    return F.when(~structure & F.length(core).between(8, 160) & core.rlike("\\p{L}"), core)


def running_headers(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """book, page and header of the pages that open with what opens over half of their book's pages, three at least.

    Positions on the page are not known here: what must stand in its top band is taken from the order of the text alone."""
    keyed = pages.select(book, page, (F.trim(text) != "").alias("__text"), header_text(F.col(text)).alias("header"))
    sized = keyed.groupBy(book).agg(F.count_if("__text").alias("__pages"))
    counts = keyed.filter("header is not null").groupBy(book, "header").agg(F.count("*").alias("__n"))
    enough = counts.join(sized, book).filter("__n >= 3 and __n * 2 > __pages").select(book, "header")
    return keyed.join(enough, [book, "header"]).select(book, page, "header")


def layout_percentiles(boxes: DataFrame, page: str, size: str) -> DataFrame:
    """Median, 90th and 95th percentile of a measure of each page's boxes."""
    at = lambda p: F.percentile(F.col(size), p)
    return boxes.groupBy(page).agg(F.median(size).alias("median"), at(0.9).alias("p90"), at(0.95).alias("p95"))


def continued_tables(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """book, page, owner and rows of every page that opens with the table the page before ends with, its header row repeated.

    owner is the page where the table begins: pages that hold nothing else are passed over. rows are the lines that move there.
    """
    blocks = F.split(F.trim(F.regexp_replace(text, "^\\s+|\\s+$", "")), "\n\\s*\n")
    table = lambda b: F.when(b.rlike("^\\|[^\n]*\\|[^\n]*\n\\|[ :|-]+\\|"), b)
    header = lambda b: F.regexp_extract(table(b), "^([^\n]*)", 1)
    cut = pages.select(book, page, F.element_at(blocks, 1).alias("__first"), F.element_at(blocks, -1).alias("__last"), F.size(blocks).alias("__n"))
    order = Window.partitionBy(book).orderBy(page)
    opens = cut.withColumn("__opens", F.coalesce(header(F.col("__first")) == F.lag(header(F.col("__last"))).over(order), F.lit(False)))
    own = F.when(~(F.col("__opens") & (F.col("__n") == 1)), F.col(page))
    owned = opens.withColumn("owner", F.max(own).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = F.slice(F.split("__first", "\n"), F.lit(3), F.size(F.split("__first", "\n")))
    return owned.filter("__opens").select(book, page, "owner", rows.alias("rows"))
