"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .stored import stored


def components(links: DataFrame) -> DataFrame:
    """links: a long, b long. Returns node, label: the smallest node that can be reached. Nodes without a link are absent.

    Each round takes the smallest label among neighbours and then follows it one step further (pointer jumping), so long
    chains close in a logarithmic number of rounds. A round's result is a written table, which cuts the lineage.
    """
    both = links.filter("a <> b").select("a", "b").unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        better = near.join(labels, "node").select("node", F.least("near", "label").alias("label"), F.col("label").alias("old"))
        ahead = better.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = better.join(ahead, better["label"] == ahead["at"]).select("node", F.col("next").alias("label"), "old")
        jumped = stored(jumped)
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels
