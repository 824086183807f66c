"""Connected groups of linked rows, by the smallest label around and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcast.sources import folders, tables


def connected(links: DataFrame, folder: str) -> DataFrame:
    """``node, group`` of all nodes of ``links`` (``a, b``, in either direction); a group is its smallest node.

    A round gives each node the smallest label of its neighbours, and then the label
    of that label, so labels travel in steps that double. Labels of neighbours are
    reduced in each task before they are shuffled, so a node with very many is a few rows.
    Each round is a written table in ``folder`` and cuts the lineage.
    """
    spark = links.sparkSession
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = tables.staged(links.select("a", "b").unionByName(turned).distinct(), f"{folder}/links")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("group"))
    labels, k = tables.staged(first, f"{folder}/labels-0"), 0
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("group").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a"))
        lower = lower.select("node", F.least("group", "near").alias("group"), F.col("group").alias("was"))
        label_of = labels.select(F.col("node").alias("_of"), F.col("group").alias("_jump"))
        moved = lower.join(label_of, F.col("group") == F.col("_of"))
        moved = moved.select("node", F.least("group", "_jump").alias("group"), "was")
        k += 1
        moved = tables.staged(moved, f"{folder}/labels-{k}")
        labels = moved.select("node", "group")
        done = moved.where("group != was").isEmpty()
        folders.delete(spark, f"{folder}/labels-{k - 1}")
        if done:
            folders.delete(spark, f"{folder}/links")
            return labels
