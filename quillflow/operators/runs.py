"""Run state: event replay, resume, reports and routing metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def replay(events: DataFrame, key: str, sequence: str, fields: list[str], status: str) -> DataFrame:
    """One row per key: the status of the latest event, and of each field the latest value that is present.

    A status that was still running at the end counts as failed. Aggregates only: events of a key are never held together.
    """
    latest = F.max_by(F.col(status), F.col(sequence))
    seen = [F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(sequence))).alias(f) for f in fields]
    out = events.groupBy(key).agg(F.coalesce(latest, F.lit("pending")).alias(status), F.max(sequence).alias("applied"), F.count("*").alias("events"), *seen)
    return out.withColumn(status, F.when(F.col(status) == "running", "failed").otherwise(F.col(status)))


def resume(saved: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Saved items keep their status, new ones are pending, and what is completed is not done again (`todo`)."""
    s, f = saved.select(F.col(key).alias("s"), "status"), found.select(F.col(key).alias("f")).distinct()
    both = s.join(f, F.col("s") == F.col("f"), "full_outer")
    status = F.coalesce("status", F.lit("pending"))
    return both.select(F.coalesce("s", "f").alias(key), status.alias("status"), (status != "completed").alias("todo"), F.col("f").isNull().alias("gone"))


def report(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of run items (kind, status, source, cached, seconds): skips count as completed, failures as pending too."""
    is_ = lambda s: F.col("status") == s
    aggs = [
        F.count("*").alias("total"), F.count_if(is_("completed") | is_("skipped")).alias("completed"), F.count_if(is_("failed")).alias("failed"),
        F.count_if(is_("failed") | is_("pending")).alias("pending"), F.count_if(F.col("cached")).alias("cache_hits"),
        F.count_distinct("source").alias("sources"), F.round(F.sum("seconds"), 4).alias("seconds"),
    ]
    return items.groupBy(*by).agg(*aggs) if by else items.agg(*aggs)


def job_status(items: DataFrame, job: str) -> DataFrame:
    """A job fails if all of its items do, is partial if some do, and runs while any item is pending."""
    n = F.count("*")
    failed, pending = F.count_if(F.col("status") == "failed"), F.count_if(F.col("status") == "pending")
    status = F.when(pending > 0, "running").when(failed == n, "failed").when(failed > 0, "partial").otherwise("completed")
    return items.groupBy(job).agg(status.alias("job_status"), n.alias("items"), failed.alias("failed"))


def recent_latency(calls: DataFrame, route: str, order: list[str], value: str, samples: int = 10) -> DataFrame:
    """Adds `latency`: the mean of a route's last `samples` values, its own included."""
    last = Window.partitionBy(route).orderBy(*order).rowsBetween(-(samples - 1), 0)
    return calls.withColumn("latency", F.avg(value).over(last))


def per_minute(calls: DataFrame, route: str, at: str, value: str) -> DataFrame:
    """Calls and summed value of each route and minute."""
    minute = F.date_trunc("minute", F.col(at))
    return calls.groupBy(F.col(route).alias("route"), minute.alias("minute")).agg(F.count("*").alias("calls"), F.round(F.sum(value), 4).alias("total"))


def batches(frames: DataFrame, group: str, order: str, size: int = 10) -> DataFrame:
    """Adds `batch`: numbers of consecutive frames of a group, `size` to a batch."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return frames.withColumn("batch", F.floor(n / size).cast("int"))


def option_differences(saved: DataFrame, now: DataFrame, run: list[str], ignored: tuple[str, ...] = ("concurrency",)) -> DataFrame:
    """run, option, difference: the options (option, value as JSON text) of each run that are not what they were."""
    s, n = saved.withColumnRenamed("value", "__saved"), now.withColumnRenamed("value", "__now")
    both = s.join(n, [*run, "option"], "full_outer").filter(~F.col("__saved").eqNullSafe(F.col("__now")) & ~F.col("option").isin(*ignored))
    shown = lambda c: F.coalesce(c, F.lit("unset"))
    said = F.concat("option", F.lit(" (saved "), shown(F.col("__saved")), F.lit(", now "), shown(F.col("__now")), F.lit(")"))
    return both.select(*run, "option", said.alias("difference"))


def usage_block(items: DataFrame, batch: str, url_list: bool) -> DataFrame:
    """Items and tokens of each batch; of a URL list only completed items count."""
    counted = items.filter("status = 'completed'") if url_list else items
    return counted.groupBy(batch).agg(F.count("*").alias("items"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def task_order(tasks: DataFrame, group: str, key: Column, order: list[str]) -> DataFrame:
    """Adds `place` (from 1) within a group; of several tasks with one key the first in order stays."""
    once = tasks.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__k = 1").drop("__k")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def numbered(parts: DataFrame, group: str, order: str) -> DataFrame:
    """Adds `number`, from 0."""
    return parts.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
