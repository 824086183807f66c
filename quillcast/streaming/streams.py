"""Streams over landed files.

Batch and stream use the same operators. A micro-batch is one run: it takes
what arrived since the last one.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillcast import fixed, schemas
from quillcast.functions import times
from quillcast.functions.urls import url_hash
from quillcast.operators.articles import ARTICLE_COLUMNS, normalise, of_type, stamp_source
from quillcast.operators.caps import feed_cap_per_document
from quillcast.operators.novelty import anti_ledger, ledger_append
from quillcast.plans.digest import digest_messages, digest_texts
from quillcast.sources import folders, tables
from quillcast.sources.feeds import parse_feeds
from quillcast.sources.kept import KeptLog


def landed(
    spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1000
) -> DataFrame:
    """Stream of the rows of Parquet files as they land in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def landed_feeds(
    spark: SparkSession, path: str, files_per_batch: int = 1000, first: int | None = None
) -> DataFrame:
    """Stream of the entries of feed files as they land in a folder, or in folders below it.

    With ``first`` only so many raw entries of each file are read.
    """
    documents = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(path, wholetext=True, recursiveFileLookup=True)
    )
    return parse_feeds(
        documents.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")),
        "path",
        first=first,
    )


def entries_of_sources(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries of landed files (``path``) with the source that they were fetched for.

    The folder of a file is named by the hash of the source's URL, the key that articles have
    for theirs, alone or as the value of a partition (``feed=<hash>``). Files in other
    folders belong to no source, and their entries are dropped.
    """
    folder = F.regexp_extract("path", r"(?:^|[/=])([^/=]+)/[^/]*$", 1)
    owner = sources.select("source_id", url_hash("url").alias("_folder"))
    return entries.withColumn("_folder", folder).join(owner, "_folder").drop("_folder")


def _batch_time(spark: SparkSession, path: str, sent_at: datetime | None) -> datetime:
    """When a batch was sent: kept at its first attempt, so that a replay has the same time."""
    kept = tables.read_table(spark, path, "sent_at timestamp_ntz").first()
    if kept:
        return kept.sent_at
    at = sent_at or datetime.now(timezone.utc)
    spark.range(1).select(times.at(at).alias("sent_at")).write.mode("overwrite").parquet(path)
    return at


def digest_stream(
    entries: DataFrame,
    sources: DataFrame | Callable[[SparkSession], DataFrame],
    root: str,
    sent_at: datetime | None = None,
    n: int = fixed.FEED_CAP,
    topic_words: dict[str, list[str]] = fixed.TOPIC_WORDS,
    zone: str = fixed.DIGEST_ZONE,
) -> StreamingQuery:
    """Find the new articles of all that landed for active feeds, write their messages and record them.

    Entries have a ``source_id``, or the ``path`` of a landed file that tells it. ``sources``
    is the registry, or a function that reads it, which is called for every micro-batch, so
    a source that was added or switched off counts from the next one on.

    Results are folders under ``root``: ``articles`` with a part per micro-batch, ``messages``
    with a run per micro-batch, the ledger, which jobs under this root share, and the
    checkpoint that numbers the batches. A replayed batch takes the articles it had written, if it
    came so far, and replaces its own messages and its part of the ledger, so it gives the same
    again and nothing twice.

    The feed cap is per source and document, so it doesn't matter which files
    share a batch. A document is the column ``document`` or ``path``, if there is
    one, and the landed file otherwise; its entries must land in one file.
    """
    spark = entries.sparkSession
    if "document" not in entries.columns:
        entries = entries.withColumn("document", F.col("path" if "path" in entries.columns else "_metadata.file_path"))

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        registry = sources(session) if callable(sources) else sources
        name, part = f"stream-{batch_id:012d}", f"{root}/articles/batch_id={batch_id}"
        ledger = tables.ledger_of(session, root)
        if not folders.complete(session, part):
            owned = batch if "source_id" in batch.columns else entries_of_sources(batch, registry)
            feeds = of_type(registry.where("active"), "rss")
            found = stamp_source(normalise(feed_cap_per_document(owned, feeds, n)), feeds)
            found = anti_ledger(found, ledger.view(without=name)).select(*ARTICLE_COLUMNS)
            found.write.mode("overwrite").parquet(part)
        new = session.read.schema(schemas.ARTICLES).parquet(part)
        at = _batch_time(session, f"{root}/times/batch_id={batch_id}", sent_at)
        texts = digest_texts(new, registry, at, topic_words=topic_words, zone=zone)
        tables.write_messages(digest_messages(texts), f"{root}/messages", at, name)
        ledger.append(name, ledger_append(new, ledger.view(without=name), at))
        ledger.fold()

    return (
        entries.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def ttl_dedup_stream(arrivals: DataFrame, key: str, time: str, ttl: str = fixed.SEEN_TTL) -> DataFrame:
    """Arrivals whose key had none within ``ttl``; state is dropped as time passes.

    The time limit ends when the watermark passes it, so a key comes back
    ``ttl`` after it was let through at the earliest.
    """
    return (
        arrivals.withColumn(time, times.instant(time))
        .withWatermark(time, ttl)
        .dropDuplicatesWithinWatermark([key])
    )


def sent_per_day_stream(ledger: DataFrame, late: str = "1 day") -> DataFrame:
    """Running number of rows sent on each day.

    Rows later than ``late`` behind the newest one are left out, and the state of a day
    ends when none can come any more.
    """
    return (
        ledger.withColumn("sent_at", times.instant("sent_at"))
        .withWatermark("sent_at", late)
        .groupBy(F.window("sent_at", "1 day").alias("day"))
        .agg(F.count("*").alias("n_sent"))
        .select(times.utc_date("day.start").alias("sent_date"), "n_sent")
    )


def day_counts(spark: SparkSession, root: str) -> KeptLog:
    """The table of counts under ``root``: the last count of a day is the highest."""
    last = lambda rows: rows.groupBy("sent_date").agg(F.max("n_sent").alias("n_sent"))
    return KeptLog(spark, f"{root}/counts", "sent_date date, n_sent bigint", ["sent_date"], 1, last)


def read_day_counts(spark: SparkSession, root: str) -> DataFrame:
    counts = day_counts(spark, root)
    return counts.reduce(counts.read())


def upsert_day_counts(counts: DataFrame, root: str) -> StreamingQuery:
    """Write the days of ``sent_per_day_stream`` that a micro-batch changes, and no others."""

    def run(batch: DataFrame, batch_id: int) -> None:
        log = day_counts(batch.sparkSession, root)
        log.append(f"batch-{batch_id:012d}", batch)
        log.fold()

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(run)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def write_available(df: DataFrame, root: str) -> DataFrame:
    """Run a stream over all that is there and give its result as a table.

    Results and checkpoint are folders under ``root`` in shared storage.
    """
    writer = df.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{root}/out").start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/out")
