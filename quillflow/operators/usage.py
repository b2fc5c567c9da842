"""Usage ledgers and prices. Money is exact: decimals of picodollars, and unknown is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MONEY = "decimal(38,12)"
CATALOGUE = 100_000  # tariffs that are broadcast at most, some megabytes


def merge_usage(ledger: DataFrame) -> DataFrame:
    """By model: requests, input_tokens, output_tokens, cost_usd (null if no request is priced), priced and unpriced requests."""
    cost = F.sum(F.col("cost_usd").cast(MONEY)).cast(MONEY)
    return ledger.groupBy("model").agg(
        F.sum("requests").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        cost.alias("cost_usd"), F.sum(F.when(F.col("cost_usd").isNotNull(), F.col("requests")).otherwise(0)).alias("priced_requests"),
        F.sum(F.when(F.col("cost_usd").isNull(), F.col("requests")).otherwise(0)).alias("unpriced_requests"),
    )


def usage_difference(after: DataFrame, before: DataFrame) -> DataFrame:
    """By model: what was added between two merged ledgers."""
    names = ["requests", "input_tokens", "output_tokens"]
    b = before.select("model", *[F.col(c).alias(f"__{c}") for c in names])
    joined = after.join(b, "model", "left")
    return joined.select("model", *[(F.col(c) - F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in names])


def cost_status(priced: Column, unpriced: Column) -> Column:
    return F.when(unpriced == 0, "complete").when(priced > 0, "partial").otherwise("unknown")


def quote(requests: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Adds `cost_usd` from tariffs(model, low, high, input, output) in picodollars a token.

    The band is chosen by the prompt's tokens; between bands and for unknown models the cost stays null. Cached tokens are
    part of the prompt and cost a tenth; batch requests cost half. Tariffs are a catalogue (one row per model and band) and
    are broadcast after a count of them; a larger one meets the requests by model.
    """
    t = tariffs.select(F.col("model").alias("__model"), "low", "high", "input", "output")
    if t.limit(CATALOGUE + 1).count() <= CATALOGUE:
        t = F.broadcast(t)
    band = (F.col("model") == F.col("__model")) & F.col("prompt_tokens").between(F.col("low"), F.col("high"))
    joined = requests.join(t, band, "left")
    d = lambda c: F.col(c).cast("decimal(20,0)")
    fresh = d("prompt_tokens") - d("cached_tokens")
    ten = fresh * d("input") * 10 + d("cached_tokens") * d("input") + d("completion_tokens") * d("output") * 10
    scale = F.when(F.col("batch"), F.lit(20)).otherwise(F.lit(10)).cast("decimal(2,0)")
    usd = (ten.cast("decimal(38,0)") / scale).cast("decimal(24,2)") * F.lit("0.000000000001").cast("decimal(13,12)")
    return joined.withColumn("cost_usd", usd.cast("decimal(38,12)")).drop("__model", "low", "high", "input", "output")


def unpriced_warning(merged: DataFrame, job: str) -> DataFrame:
    """Per job: a sentence that names the first three models without a price and counts the rest; null where all have one."""
    names = F.array_sort(F.collect_set(F.when(F.col("unpriced_requests") > 0, F.col("model"))))
    out = merged.groupBy(job).agg(names.alias("names"))
    shown, more = F.array_join(F.slice("names", 1, 3), ", "), F.size("names") - 3
    rest = F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise("")
    return out.select(job, F.when(F.size("names") > 0, F.concat(F.lit("no price is known for "), shown, rest)).alias("warning"))
