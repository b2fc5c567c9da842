"""Streaming ingest: new rows are converted and published as they arrive. An addition of this engine to its batch work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import naming
from ..sources import blocks as B, html as H


def pages_stream(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, html of Parquet files that arrive in a folder."""
    return spark.readStream.schema("page_id long, url string, html string").parquet(folder)


def convert_and_publish(pages: DataFrame, table: str, checkpoint: str, name: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Converts each micro-batch, names it against what the table holds, and appends. A batch is written under its number, so
    a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        once = naming.first_of_each(batch, F.col("url"), ["page_id"])
        docs = B.assemble(B.without_repeats(H.extract(once)))
        named = name(once.select(F.col("page_id").cast("string").alias("key"), "url")).join(docs, "key")
        try:
            before = spark.read.parquet(table).filter(F.col("batch") != number).select(F.col("target").alias("name"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise  # else nothing is published yet
            before = spark.createDataFrame([], "name string")
        planned = naming.plan_outputs(naming.unique_names(named, "name", ["key"]).withColumn("name", F.col("unique_name")), before, "name", "rename")
        planned.select("key", "url", "target", "markdown", "title", "word_count", "error").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_per_window(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of each event type and window; events later than `late` are not waited for."""
    seen = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return seen.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
