"""Sinks: front matter, profiles, envelopes, image lists and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.text import yaml_scalar

#: Fixed order of a document's front matter.
FIRST_KEYS = ("title", "source", "description", "tags", "processed", "fetch_strategy")


def front_matter(fields: dict[str, Column]) -> Column:
    """YAML front matter in the fixed order, then by the order given; null fields are left out, arrays become lists."""
    order = [k for k in FIRST_KEYS if k in fields] + [k for k in fields if k not in FIRST_KEYS]
    lines = []
    for k in order:
        if k == "tags":
            items = F.concat_ws("\n", F.transform(fields[k], lambda x: F.concat(F.lit("- "), yaml_scalar(x))))
            lines.append(F.when(F.size(fields[k]) > 0, F.concat(F.lit("tags:\n"), items)))
        else:
            lines.append(F.concat(F.lit(f"{k}: "), yaml_scalar(fields[k].cast("string"))))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))


def render(docs: DataFrame, fields: dict[str, Column], body: str = "markdown") -> DataFrame:
    """Adds `rendered`: front matter and body."""
    return docs.withColumn("rendered", F.concat(front_matter(fields), F.coalesce(F.col(body), F.lit(""))))


def okf(meta: Column, by: str, at: Column) -> Column:
    """A metadata map in the open knowledge form: type defaults to Document, source becomes resource, generation is named.

    Applying it twice changes nothing."""
    has = lambda k: F.map_contains_key(meta, k)
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(meta, lambda k, v: k != "source")
    kind = F.when(has("type"), empty).otherwise(F.create_map(F.lit("type"), F.lit("Document")))
    place = F.when(has("source") & ~has("resource"), F.create_map(F.lit("resource"), meta["source"])).otherwise(empty)
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    made = F.when(has("generated"), empty).otherwise(F.create_map(F.lit("generated"), F.concat(F.lit(by), F.lit(" "), stamp)))
    return F.map_concat(kept, kind, place, made)


def envelope(items: DataFrame, order: str, version: int = 1) -> DataFrame:
    """The JSON lines of each batch (column `batch`): first one with version, ok, error and totals (`order` null), then one
    for each item. A batch may have any number of items; no row holds them all."""
    n, failed = F.count("*"), F.count_if(F.col("status") == "failed")
    counts = [n.alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "skipped")], failed.alias("failed")]
    totals = items.groupBy("batch").agg(F.struct(*counts).alias("totals"))
    ok = F.col("totals.failed") == 0
    error = F.when(~ok, F.concat(F.col("totals.failed").cast("string"), F.lit(" items failed")))
    spell = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("line")
    nothing = F.lit(None).cast(items.schema[order].dataType).alias(order)
    head = totals.select("batch", nothing, spell(F.lit(version).alias("version"), ok.alias("ok"), error.alias("error"), F.col("batch"), F.col("totals")))
    return head.unionByName(items.select("batch", order, spell(*[F.col(c) for c in items.columns if c != "batch"])))


def merge_images(old: DataFrame, new: DataFrame, key: str = "asset") -> DataFrame:
    """Keyed upsert of image descriptions: the newer row of an asset wins."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__new")))
    return both.withColumn("__n", n).filter("__n = 1").drop("__n", "__new")


def publish(docs: DataFrame, folder: str) -> None:
    """Writes target and rendered text as a table; Spark's committer makes each write whole or absent."""
    docs.select("target", "rendered").write.mode("overwrite").parquet(folder)


def publish_files(docs: DataFrame, folder: str) -> int:
    """Writes each row's rendered text to folder/target on a file system that all executors share; returns the files.

    A file appears under its name only when it is whole, so a retried task replaces it by the same bytes."""

    def go(frames):
        import os
        import uuid

        import pandas as pd

        for frame in frames:
            for target, text in zip(frame["target"], frame["rendered"]):
                path = os.path.join(folder, target)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(part := f"{path}.{uuid.uuid4().hex}.part", "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(part, path)
            yield pd.DataFrame({"n": [len(frame)]})

    return docs.select("target", "rendered").mapInPandas(go, "n long").agg(F.sum("n")).first()[0] or 0
