"""A training-data pipeline: documents in, token digests of the clean ones out.

Each stage gets what its predecessor kept, written as Parquet and read again, so a lost
executor costs a re-read of one table. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillcast.llm import bpe_rounds, line_chunks, quality_pairs, spaced_seeds, token_groups
from quillcast.llm.common import fold, forget, scratch, small_batches, staged, table

GOOD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; a fifth of the labels is not learned from."""
    small_batches(spark)
    model = quality_pairs.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0, lands_at=GOOD)
    return quality_pairs.good_documents(docs, model, GOOD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand elsewhere before."""
    small_batches(spark)
    return line_chunks.line_dedup(spark, docs, scratch(spark)).drop("_removed")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return token_groups.one_of_each(spark, docs, scratch(spark))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    folder = scratch(spark)
    found = spaced_seeds.leaks(docs, table(spark, sf_dir, "benchmark"), folder)
    return spaced_seeds.clean_documents(docs, staged(found, folder, "leaks"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of token ids, and digests of the ids and of the text decoded from them."""
    small_batches(spark)
    return bpe_rounds.round_trips(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

# SQL can't express the fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark)
    for number, (name, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), folder, f"{number}-{name}")
        if number:
            forget(spark, folder, f"{number - 1}-{STAGES[number - 1][0]}")
    return docs
