"""Routing: readers by extension, path globs, and dates in identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.urls import glob_pattern

#: Extensions of each reader.
READERS = {
    "text": "txt md markdown",
    "html": "html htm xhtml",
    "delimited": "csv tsv",
    "json": "json",
    "xml": "xml",
    "notebook": "ipynb",
    "mail": "eml",
    "outlook": "msg",
    "rst": "rst",
    "org": "org",
    "tex": "tex",
    "word": "docx docm dotx dotm doc dot",
    "slides": "pptx pptm ppsx ppsm potx potm ppt pps pot",
    "sheet": "xlsx xlsm xlsb xltx xltm xls xlt",
    "opendocument": "odt ods odp ott ots otp",
    "rtf": "rtf",
    "numbers": "numbers",
    "epub": "epub",
    "pdf": "pdf",
    "image": "jpg jpeg png gif bmp tif tiff webp heic heif avif svg",
}


def with_reader(files: DataFrame, path: str) -> DataFrame:
    """Adds `reader` by the path's extension, letter case aside; null where none fits."""
    ext = F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))
    by_ext = {e: r for r, es in READERS.items() for e in es.split()}
    lookup = F.create_map(*[F.lit(x) for pair in by_ext.items() for x in pair])
    return files.withColumn("reader", F.try_element_at(lookup, ext))


def matching(files: DataFrame, path: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Adds `kept`: whether a path matches an include glob and no exclude glob."""
    any_of = lambda globs: F.exists(F.array(*[F.col(path).rlike(glob_pattern(g)) for g in globs]), lambda x: x) if globs else F.lit(False)
    return files.withColumn("kept", any_of(include) & ~any_of(exclude))


def _div(value: Column, by: int) -> Column:
    """Whole-number division, rounded down, exact for integers and decimals of any length."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def from_filetime(ticks: Column) -> Column:
    """100 ns ticks since 1601 as a timestamp. ticks: a whole number, a decimal(n, 0) where 64 bits do not hold it."""
    return F.timestamp_micros(_div(ticks - 116444736000000000, 10))


def from_post_id(post_id: Column) -> Column:
    """Creation time in a time-ordered post id; ids from before that scheme have none. post_id: a whole number, a decimal(n, 0)
    where 64 bits do not hold it."""
    return F.when(post_id >= 30000000000, F.timestamp_millis(_div(post_id, 1 << 22) + 1288834974657))


def shown_images(images: DataFrame) -> DataFrame:
    """Images whose size says that they carry content: 50 pixels either way and 5,000 in all."""
    return images.filter("width >= 50 and height >= 50 and width * height >= 5000")


def suggestions(words: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """word, suggestion: the known word nearest to each unknown one within `most` edits, the first of equals.

    known: one column `name`, a small command vocabulary. Words meet it by length first."""
    k = known.select(F.col("name").alias("suggestion"), F.explode(F.sequence(F.length("name") - most, F.length("name") + most)).alias("len"))
    pairs = words.select("word", F.length("word").alias("len")).join(k, "len").withColumn("d", F.levenshtein("word", "suggestion", most))
    best = pairs.filter("d >= 0").groupBy("word").agg(F.min(F.struct("d", "suggestion")).alias("m"))
    return best.select("word", F.col("m.suggestion").alias("suggestion"), F.col("m.d").alias("edits"))


def batch_lines(requests: DataFrame, model: str, url: str = "/v1/chat/completions") -> DataFrame:
    """custom_id and line: requests (key, prompt) as the JSON lines of a provider's batch; equal prompts are sent once."""
    custom = F.substring(F.sha2("prompt", 256), 1, 16)
    once = requests.groupBy(custom.alias("custom_id")).agg(F.min("prompt").alias("prompt"), F.count("*").alias("uses"))
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    body = F.struct(F.lit(model).alias("model"), message.alias("messages"))
    line = F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body")))
    return once.select("custom_id", line.alias("line"), "uses")


def reconcile(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests (key, prompt) with the answer (custom_id, answer) of their prompt; null where none came back."""
    custom = F.substring(F.sha2("prompt", 256), 1, 16)
    return requests.withColumn("custom_id", custom).join(answers, "custom_id", "left").drop("custom_id")
