"""Per-group caps.

Each is a ``row_number() <= n`` filter. Spark turns that into a group limit
before the shuffle, so a map task sends at most ``n`` rows of a group and one
huge source or digest never reaches a single task. That holds up to
``spark.sql.optimizer.windowGroupLimitThreshold`` (1000); raise it for larger caps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillcast import fixed
from quillcast.operators.skew import join_one


def first_per_group(
    df: DataFrame, group: list[str], order: list, n: int, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows of each group; ``rank`` names a column for their place from 1."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    first = df.withColumn(rank or "_rank", place).where(F.col(rank or "_rank") <= n)
    return first if rank else first.drop("_rank")


def feed_cap(entries: DataFrame, n: int = fixed.FEED_CAP) -> DataFrame:
    """First ``n`` raw entries of each source, counted before any is dropped.

    Entries of several documents of a source may share a position. The document's number, if
    there is one, and then the entry itself put them in order, so there are never more than ``n``.
    """
    return first_per_group(entries, ["source_id"], _entry_order(entries), n)


def _entry_order(entries: DataFrame) -> list[str]:
    return [c for c in ("document", "position", "link", "title", "summary", "description") if c in entries.columns]


def feed_cap_of(entries: DataFrame, sources: DataFrame, n: int = fixed.FEED_CAP) -> DataFrame:
    """The feed cap for the entries of the given sources; others are dropped before they are ranked."""
    return feed_cap(entries.join(sources.select("source_id"), "source_id", "left_semi"), n)


def feed_cap_per_document(entries: DataFrame, sources: DataFrame, n: int = fixed.FEED_CAP) -> DataFrame:
    """The feed cap for each document of the given sources by itself."""
    of_sources = entries.join(sources.select("source_id"), "source_id", "left_semi")
    return first_per_group(of_sources, ["source_id", "document"], _entry_order(entries), n)


def first_link(links: DataFrame) -> DataFrame:
    """First occurrence of each URL of a source."""
    return first_per_group(links, ["source_id", "url"], ["page_id", "pos"], 1)


def crawl_cap(links: DataFrame, n: int = fixed.FEED_CAP, rank: str | None = None) -> DataFrame:
    """First ``n`` links of each source; apply it to valid and distinct links."""
    return first_per_group(links, ["source_id"], ["page_id", "pos"], n, rank)


def digest_cap(articles: DataFrame, n: int = fixed.DIGEST_CAP) -> DataFrame:
    """First ``n`` articles of each digest, in order of source, position and URL."""
    return first_per_group(articles, ["digest_id"], _places(articles), n)


def _places(articles: DataFrame) -> list[str]:
    return [c for c in ("source_id", "position", "url_hash") if c in articles.columns]


def digest_overflow(articles: DataFrame, n: int = fixed.DIGEST_CAP) -> DataFrame:
    """Articles beyond the digest cap: sent and recorded, but never shown.

    Ranking a whole digest would take one task. The last shown article of each
    full digest is found under the cap instead, and rows are compared with it.
    """
    places = _places(articles)
    place = F.struct(*places)
    last_shown = (
        digest_cap(articles.select("digest_id", *places), n)
        .groupBy("digest_id")
        .agg(F.max(place).alias("_last"), F.count("*").alias("_shown"))
        .where(F.col("_shown") == n)
        .select("digest_id", "_last")
    )
    joined = join_one(articles, last_shown, ["digest_id"], ["source_id", "position"])
    return joined.where(place > F.col("_last")).drop("_last")
