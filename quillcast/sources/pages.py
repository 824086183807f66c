"""Landed web pages and repository listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast import schemas


def read_pages(spark: SparkSession, path: str, body: str = "body") -> DataFrame:
    """Landed pages that have content."""
    return with_content(spark.read.parquet(path), body)


def with_content(pages: DataFrame, body: str = "body") -> DataFrame:
    """Drop the pages whose body is null or empty."""
    return pages.where(F.col(body) != "")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Repository listing pages that were fetched without error."""
    return fetched_only(spark.read.schema(schemas.LISTING).json(path))


def fetched_only(responses: DataFrame) -> DataFrame:
    """Drop the responses that are errors."""
    return responses.where("status = 200").drop("status")
