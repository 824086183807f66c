"""Counts and status reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcast import fixed
from quillcast.functions import times


def count_sent_today(ledger: DataFrame, asof: datetime, tz: str = "UTC") -> DataFrame:
    """Rows sent since the last midnight in ``tz``; ``asof`` and the ledger are in UTC.

    A ledger with a folder per day is read from that day's folder on.
    """
    midnight = times.day_start(times.at(asof), tz)
    recent = ledger.where(F.col("sent_at") >= midnight)
    if "sent_date" in ledger.columns:
        recent = recent.where(F.col("sent_date") >= F.to_date(midnight))
    return recent.agg(F.count("*").alias("sent_today"))


def sent_per_day(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.to_date("sent_at").alias("sent_date")).agg(F.count("*").alias("n_sent"))


def source_counts(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles per source, sources without any included, and the total."""
    counts = articles.groupBy("source_id").agg(F.count("*").alias("n"))
    per_source = sources.select("source_id", "name").join(counts, "source_id", "left")
    return (
        per_source.rollup("source_id")
        .agg(
            F.when(F.grouping("source_id") == 1, "total").otherwise(F.max("name")).alias("name"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("fetched"),
        )
        .select("source_id", "name", "fetched")
    )


def status_report(
    sources: DataFrame, ledger: DataFrame, asof: datetime, tz: str = "UTC"
) -> DataFrame:
    """One row: active sources and articles sent today."""
    sent = count_sent_today(ledger, asof, tz).scalar()
    return sources.agg(F.count_if("active").alias("active_sources")).select(
        "active_sources", sent.alias("sent_today")
    )


def status_text(report: DataFrame) -> DataFrame:
    """The status report as a message."""
    text = F.format_string(fixed.STATUS, "active_sources", "sent_today")
    return report.select(text.alias("message"))
