"""Connected components of links, by the smallest label around and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcast.llm.common import forget, staged


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """``node, component`` of all nodes of ``links`` (``a, b``); a component is its smallest node.

    A round gives each node the smallest label of its neighbours, then the label of that
    label, so labels travel in steps that double. Only labels are moved, and only small
    rows: a node with very many neighbours is aggregated before the shuffle.
    """
    spark = links.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.distinct(), folder, f"{name}-links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels, k = staged(labels, folder, f"{name}-0"), 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b")
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(least, "node").select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("was")
        )
        of_label = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        moved = lower.join(of_label, "component").select(
            "node", F.least("component", "jump").alias("component"), "was"
        )
        k += 1
        moved = staged(moved, folder, f"{name}-{k}")
        forget(spark, folder, f"{name}-{k - 1}")
        labels = moved.select("node", "component")
        if moved.where("component != was").isEmpty():
            forget(spark, folder, f"{name}-links")
            return labels
