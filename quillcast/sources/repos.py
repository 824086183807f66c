"""Landed repository metadata and search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast import schemas


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    """Repositories from landed lookup responses."""
    return parse_repos(spark.read.schema(schemas.REPO_RESPONSE).json(path))


def parse_repos(responses: DataFrame) -> DataFrame:
    """Repositories of the responses (path, status, body) that succeeded."""
    return (
        responses.where("status = 200")
        .select("path", F.from_json("body", schemas.REPO).alias("repo"))
        .where("repo.full_name is not null")
        .select("path", "repo.*")
    )


def read_search(spark: SparkSession, path: str) -> DataFrame:
    """Repositories from landed search responses, one JSON document per line."""
    return parse_search(spark.read.text(path).withColumnRenamed("value", "body"))


def parse_search(responses: DataFrame) -> DataFrame:
    """Repositories of search responses (body); a response without items gives none."""
    return (
        responses.select(F.from_json("body", schemas.SEARCH).alias("r"))
        .select(F.explode("r.items").alias("repo"))
        .select("repo.*")
    )
