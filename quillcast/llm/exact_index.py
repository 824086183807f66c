"""Exact dedup against a digest index that is kept between runs.

The index is a Parquet table bucketed and sorted by digest, one row per distinct
text: the row that stays, the characters of its original and how many rows had
that text. A run brings its rows to one per digest, looks up which digests are
known in a sort-merge anti-join, and appends the new ones. Known digests of which
the run brings more rows get a further entry; readers fold the entries of a digest.

Everything is DataFrame operations. A digest with very many rows is counted before
the shuffle, so that the index and its buckets have one small row per digest.

Nulls count as empty texts. Rows without an id may have copies, and stay only if
no copy has an id. Very long texts are digested whole. Repeated rows, ids included, count as copies and all of them are kept
or dropped alike. An empty table leaves the index as it is. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast.llm.common import BLANKS, scratch, staged

ENTRY = "text_sha256 string, keep_id bigint, keep_chars bigint, n bigint, run string"


def digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, digest of the text without blanks, and characters of the original."""
    original = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.sha2(F.translate(original, BLANKS, "").cast("binary"), 256).alias("text_sha256"),
        F.length(original).cast("bigint").alias("chars"),
    )


def best() -> list:
    """Aggregates that pick the row that stays: most characters, then the smallest id."""
    order = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"))
    return [F.min(order).alias("_best"), F.sum("n").alias("n")]


def unpacked(groups: DataFrame) -> DataFrame:
    return groups.select(
        "text_sha256", F.col("_best.i").alias("keep_id"), (-F.col("_best.c")).alias("keep_chars"), "n"
    )


class DigestIndex:
    """An index in ``folder``, on storage that all executors reach.

    ``run`` names of ``add`` make it repeatable: rows of a run that has been added are
    not added again.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        # by the whole path, so that no two folders share a table
        self.name = "digest_index_" + hashlib.sha256(folder.encode()).hexdigest()[:40]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({ENTRY}) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        """One row per digest. Buckets keep a digest in place, so nothing is shuffled."""
        rows = self.entries().select(
            "text_sha256", F.col("keep_id").alias("doc_id"), F.col("keep_chars").alias("chars"), "n"
        )
        return unpacked(rows.groupBy("text_sha256").agg(*best()))

    def add(self, rows: DataFrame, run: str) -> None:
        """Append the digests of ``rows`` (as ``digests`` gives them) that are new."""
        groups = unpacked(rows.withColumn("n", F.lit(1)).groupBy("text_sha256").agg(*best()))
        done = self.entries().where(F.col("run") == run).select("text_sha256").hint("merge")
        groups = groups.join(done, "text_sha256", "left_anti")
        known = self.entries().select("text_sha256").hint("merge")
        known_before = not self.entries().isEmpty()
        self._append(groups.join(known, "text_sha256", "left_anti").withColumn("run", F.lit(run)))
        if known_before:
            self._append(groups.join(known, "text_sha256", "left_semi").withColumn("run", F.lit(run)))

    def _append(self, rows: DataFrame) -> None:
        # one task per bucket, hence one sorted file per bucket and run
        (
            rows.repartition(self.buckets, "text_sha256")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "text_sha256")
            .sortBy("text_sha256")
            .saveAsTable(self.name)
        )


def lookup(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Every row with the row of its text that stays.

    ``index`` should be a plain table: with both sides straight from a shuffle Spark splits
    the partition of a digest that has very many rows.
    """
    return rows.join(index, "text_sha256").select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(spark: SparkSession, docs: DataFrame, folder: str, run: str = "first") -> DataFrame:
    """Add documents to the index in ``folder`` and return what became of each."""
    index = DigestIndex(spark, folder)
    rows = digests(docs)
    index.add(rows, run)
    return lookup(rows, staged(index.read(), scratch(spark), "folded"))
