"""Raw entries to articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcast import fixed
from quillcast.functions.text import plain_summary, trim_blank
from quillcast.functions.times import published_at
from quillcast.functions.urls import url_hash

ARTICLE_COLUMNS = [
    "source_id", "source_name", "digest_id", "position", "title", "url", "summary",
    "published_at", "url_hash",
]


def normalise(entries: DataFrame) -> DataFrame:
    """Entries with a link, as clean articles keyed by the hash of their URL."""
    url = trim_blank(F.coalesce("link", F.lit("")))
    published = published_at("published") if "published" in entries.columns else F.lit(None)
    return (
        entries.withColumn("url", url)
        .where("url <> ''")
        .select(
            "source_id",
            "position",
            trim_blank(F.coalesce("title", F.lit(fixed.NO_TITLE))).alias("title"),
            "url",
            plain_summary("summary", "description").alias("summary"),
            published.cast("timestamp_ntz").alias("published_at"),
            url_hash("url").alias("url_hash"),
        )
    )


def stamp_source(
    articles: DataFrame, sources: DataFrame, on: list[str] | None = None
) -> DataFrame:
    """Add name and digest of the source; articles of other sources are dropped.

    Apply it after the cap, when a source has a handful of rows and no key is
    hot. The size of the registry decides at run time whether it is broadcast.
    """
    on = on or ["source_id"]
    names = sources.select(*on, F.col("name").alias("source_name"), "digest_id")
    return articles.join(names, on)


def of_type(sources: DataFrame, kind: str) -> DataFrame:
    return sources.where(F.col("type") == kind)


def unknown_types(sources: DataFrame) -> DataFrame:
    """Sources of a type no branch reads; they are skipped, not an error."""
    return sources.where(~F.coalesce(F.col("type").isin("rss", "crawl"), F.lit(False)))


def route_by_type(sources: DataFrame) -> DataFrame:
    """Every source with the branch that reads it."""
    return sources.withColumn(
        "route",
        F.when(F.col("type") == "rss", "feed").when(F.col("type") == "crawl", "page").otherwise("skip"),
    )
