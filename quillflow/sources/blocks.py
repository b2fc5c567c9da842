"""The blocks of a document: what every reader yields, one row each, and how rows become Markdown again.

A block is (key, pos, kind, level, text). Readers are small Python helpers that emit blocks; filtering, de-duplication,
counting, titles and assembly are DataFrame operations over the block table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.batches import small_batches
from . import references

SCHEMA = "key string, pos int, kind string, level int, text string"
KINDS = ("title", "meta", "heading", "paragraph", "item", "ordered", "quote", "code", "row", "image", "rule", "note", "definition", "asset", "chrome", "warning", "error")


def dealt(df: DataFrame) -> DataFrame:
    """df, its rows dealt out anew if it has fewer partitions than the cluster has cores: a small file is one partition. They
    go to Python in small batches."""
    small_batches(df)
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def read(df: DataFrame, key: str, content: str, reader: Callable[..., Iterator[tuple]], *more: str) -> DataFrame:
    """Blocks of each row's content: reader(content, *more) yields (kind, level, text).

    A row that fails gives one `error` block and does not stop the job; null content gives no block.
    """
    df = dealt(df.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"), *[F.col(c) for c in more]))

    def go(frames):
        for frame in frames:
            rows = []
            for k, data, *rest in frame.itertuples(index=False, name=None):
                if data is None:
                    continue
                try:
                    rows += [(k, pos, *block) for pos, block in enumerate(reader(data, *rest))]
                except Exception as e:  # a damaged input is a row, not a failure
                    rows.append((k, 0, "error", 0, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["key", "pos", "kind", "level", "text"])

    return df.mapInPandas(go, SCHEMA)


def without_repeats(blocks: DataFrame, least: int = 30) -> DataFrame:
    """Without blocks of `least` characters or more that equal the block before them, emphasis of a whole block and line breaks
    at its end aside."""
    aside = F.col("kind").isin("title", "meta", "warning")
    said = F.regexp_replace("text", "(?s)^(\\*\\*|\\*|~~|`)(.*?)\\s*\\1$", "$2")
    before = F.lag(F.struct("kind", said)).over(Window.partitionBy("key", "__aside").orderBy("pos"))
    same = ~F.col("__aside") & (before == F.struct("kind", said)) & (F.length(said) >= least) & ~F.col("kind").isin("row", "code")
    marked = blocks.withColumn("__aside", aside).withColumn("__same", F.coalesce(same, F.lit(False)))
    return marked.filter("not __same").drop("__aside", "__same")


def without_empty_sections(blocks: DataFrame) -> DataFrame:
    """Without headings that nothing stands under: no content before the next heading of their level or a higher one, or the
    end. Headings over deeper ones go only if those do. The first heading stays if it is a title (level 1)."""
    head, level = F.col("kind") == "heading", F.col("level")
    content = ~F.col("kind").isin("heading", "title", "meta", "warning", "error", "chrome")
    after = Window.partitionBy("key").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # running minima from the end: where content comes next, and a heading of each level or higher
    marked = blocks.withColumn("__content", F.min(F.when(content, F.col("pos"))).over(after))
    nexts = [F.min(F.when(head & (level <= k), F.col("pos"))).over(after).alias(f"__h{k}") for k in range(1, 7)]
    marked = marked.select("*", *nexts, F.count_if(head).over(first).alias("__heads"))
    until = F.element_at(F.array(*[F.col(f"__h{k}") for k in range(1, 7)]), F.least(F.greatest(level, F.lit(1)), F.lit(6)))
    empty = F.col("__content").isNull() | F.coalesce(until < F.col("__content"), F.lit(False))
    title = (level == 1) & (F.col("__heads") == 0)
    return marked.filter(~(head & empty & ~title)).select(*blocks.columns)


def table_rows(blocks: DataFrame) -> DataFrame:
    """Pads the rows of each table to its widest and adds the separator below the first. A row's cells are joined by U+001F."""
    per = Window.partitionBy("key", "__row", "level")
    rows = blocks.withColumn("__row", F.col("kind") == "row").withColumn("__cells", F.when(F.col("__row"), F.split("text", "\x1f")))
    wide = rows.withColumn("__width", F.max(F.size("__cells")).over(per)).withColumn("__n", F.row_number().over(per.orderBy("pos")))
    padded = F.concat("__cells", F.array_repeat(F.lit(""), F.col("__width") - F.size("__cells")))
    line = F.concat(F.lit("| "), F.array_join(F.transform(padded, T.table_cell), " | "), F.lit(" |"))
    under = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("__width")), " | "), F.lit(" |"))
    text = F.when(~F.col("__row"), F.col("text")).when(F.col("__n") == 1, F.concat(line, under)).otherwise(line)
    return wide.select("key", "pos", "kind", "level", text.alias("text"))


def markdown_of(kind: Column, level: Column, text: Column) -> Column:
    """A block's Markdown. The text of code may begin with its language and U+001F."""
    language, code = F.regexp_extract(text, "^([^\x1f]*)\x1f", 1), F.regexp_replace(text, "^[^\x1f]*\x1f", "")
    mark = T.fence(code)
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(level, F.lit(6))), F.lit(" "), text))
        .when(kind == "item", F.concat(F.repeat(F.lit("  "), level), F.lit("- "), text))
        .when(kind == "quote", F.regexp_replace(text, "(?m)^", "> "))
        .when(kind == "ordered", F.concat(F.repeat(F.lit("  "), level), text))
        .when(kind == "code", F.concat(mark, language, F.lit("\n"), code, F.lit("\n"), mark))
        .when(kind == "rule", F.lit("---"))
        .otherwise(text)
    )


def assemble(blocks: DataFrame) -> DataFrame:
    """key, markdown, title, word_count, warnings, error: one row per document.

    References to notes and assets are resolved first. Items and rows of a table follow each other closely, other blocks stand apart by a blank line.
    """
    shown = ~F.col("kind").isin("title", "meta", "warning", "error", "chrome")
    laid = table_rows(references.resolved(blocks, markdown_of))
    part = F.struct("pos", "kind", markdown_of(F.col("kind"), F.col("level"), F.col("text")).alias("md"), "level")
    grouped = laid.groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(shown, part))).alias("parts"),
        F.min_by(F.when(F.col("kind") == "title", F.col("text")), F.when(F.col("kind") == "title", F.col("pos"))).alias("own_title"),
        F.min_by(F.when(F.col("kind") == "heading", F.col("text")), F.when(F.col("kind") == "heading", F.col("pos"))).alias("heading"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "warning", F.struct("pos", "text")))).alias("warned"),
        F.first(F.when(F.col("kind") == "error", F.col("text")), ignorenulls=True).alias("error"),
    )
    close = lambda k: k.isin("item", "ordered", "row")
    joined = F.aggregate(
        "parts", F.struct(F.lit("").alias("md"), F.lit("").alias("kind"), F.lit(0).alias("level")),
        lambda s, p: F.struct(
            F.when(s["md"] == "", p["md"]).otherwise(
                F.concat(s["md"], F.when(close(p["kind"]) & (s["kind"] == p["kind"]) & ((p["kind"] != "row") | (s["level"] == p["level"])), "\n").otherwise("\n\n"), p["md"])
            ).alias("md"), p["kind"].alias("kind"), F.coalesce(p["level"], F.lit(0)).alias("level"),
        ),
    )
    out = grouped.withColumn("markdown", joined["md"]).withColumn("heading", F.regexp_replace("heading", "\\[\\^[0-9]+\\]", ""))
    none = (F.trim("markdown") == "") & F.col("error").isNull()
    return out.select(
        "key", F.when(F.col("markdown") == "", "").otherwise(F.concat("markdown", F.lit("\n"))).alias("markdown"),
        F.coalesce(T.plain_title(F.col("own_title")), T.plain_title(F.col("heading"))).alias("title"), T.word_count(F.col("markdown")).alias("word_count"),
        F.array_distinct(F.transform("warned", lambda w: w["text"])).alias("warnings"), F.when(none, "no extractable content").otherwise(F.col("error")).alias("error"),
    )
