"""The digest job."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast import fixed, schemas
from quillcast.functions import times
from quillcast.functions.text import escape_markup
from quillcast.operators import articles as A
from quillcast.operators import compose as C
from quillcast.operators.caps import digest_cap, feed_cap_of
from quillcast.operators.links import crawl_articles, top_links
from quillcast.operators.near_dup import near_dup_keep_shown
from quillcast.operators.novelty import filter_new_articles, ledger_append, marks_of
from quillcast.operators.seen_set import seen_set_live
from quillcast.operators.topics import topic_assign
from quillcast.sources import tables


def fetched_articles(
    sources: DataFrame, entries: DataFrame, pages: DataFrame, n: int = fixed.FEED_CAP
) -> DataFrame:
    """Articles of all active sources: entries of feeds and links of crawled pages.

    Entries and pages of other sources go before they are read or ranked. Caps come
    before names are added: they are per source, so the result is the same, and no
    source is left with many rows to join.
    """
    of_kind = lambda df, kind: df.withColumn("type", F.lit(kind))
    active = sources.where("active")
    capped = feed_cap_of(entries, A.of_type(active, "rss"), n)
    from_feeds = of_kind(A.normalise(capped), "rss")
    crawled = A.of_type(active, "crawl").select("source_id")
    links = top_links(pages.join(crawled, "source_id", "left_semi"), "source_id", "page_id", n=n)
    from_pages = of_kind(crawl_articles(links, n), "crawl")
    return A.stamp_source(
        from_feeds.unionByName(from_pages), active, ["source_id", "type"]
    ).select(*A.ARTICLE_COLUMNS)


def digest_texts(
    new: DataFrame,
    sources: DataFrame,
    asof: datetime,
    n: int = fixed.DIGEST_CAP,
    topic_words: dict[str, list[str]] = fixed.TOPIC_WORDS,
    bodies: DataFrame | None = None,
    footer: str = fixed.DIGEST_FOOTER,
    zone: str = fixed.DIGEST_ZONE,
) -> DataFrame:
    """Whole text of each digest, dated in the zone of its readers.

    ``bodies`` (digest_id, body) holds digest texts written elsewhere; digests
    it lacks get raw headlines. Without it the body is composed here.
    """
    if bodies is None:
        body = C.digest_bodies(topic_assign(near_dup_keep_shown(digest_cap(new, n)), topic_words))
    else:
        body = C.digest_or_fallback(digest_cap(new, n), bodies).select("digest_id", "body")
    return C.compose_digest(body, C.digest_header(new, sources, asof, zone), footer)


def run_outcome(
    sources: DataFrame, fetched: DataFrame, new: DataFrame
) -> DataFrame:
    """What a run comes to for each digest, and the notice it sends in place of one."""
    count = lambda df, name: df.groupBy("digest_id").agg(F.count("*").alias(name))
    counted = (
        sources.groupBy("digest_id")
        .agg(F.count_if("active").alias("n_sources"))
        .join(count(fetched, "n_fetched"), "digest_id", "left")
        .join(count(new, "n_new"), "digest_id", "left")
        .na.fill(0, ["n_fetched", "n_new"])
    )
    outcome = (
        F.when(F.col("n_sources") == 0, "no_sources")
        .when(F.col("n_fetched") == 0, "nothing_fetched")
        .when(F.col("n_new") == 0, "nothing_new")
        .otherwise("sent")
    )
    notice = F.when(F.col("outcome") == "nothing_fetched", fixed.NOTHING_FETCHED).when(
        F.col("outcome") == "nothing_new", fixed.NOTHING_NEW
    )
    return counted.withColumn("outcome", outcome).withColumn("notice", escape_markup(notice))


def digest_messages(texts: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Messages of a run: the chunks of each digest, or the notice of one without articles."""
    messages = C.split_messages(texts, "digest_id")
    if outcomes is None:
        return messages
    notices = outcomes.where("notice is not null").select(
        "digest_id", F.lit(0).alias("chunk_no"), F.col("notice").alias("chunk")
    )
    return messages.unionByName(notices)


def run_digest(
    spark: SparkSession,
    sources: DataFrame,
    entries: DataFrame,
    pages: DataFrame,
    root: str,
    asof: datetime,
    ttl: str = fixed.SEEN_TTL,
    topic_words: dict[str, list[str]] = fixed.TOPIC_WORDS,
    bodies: DataFrame | None = None,
    zone: str = fixed.DIGEST_ZONE,
) -> None:
    """Run the job once and keep its results under ``root`` in shared storage.

    The articles of the run are written first: messages, marks and ledger all
    start from that table, so nothing is computed twice and lost executors cost
    no more than the stage at hand. Every write replaces its own run's folder or
    skips what is there, so a run that failed half-way can be repeated. The
    ledger comes last, and gets all new articles, shown or not. A stream under the same
    root keeps the same ledger, so neither sends what the other has sent.
    """
    name = f"run-{asof:%Y%m%dT%H%M%S}"
    run = f"{root}/runs/{asof:%Y%m%dT%H%M%S}"
    ledger = tables.ledger_of(spark, root)
    marks = tables.read_table(spark, f"{root}/marks", schemas.MARKS)
    before = marks.where(F.col("marked_at") < times.at(asof))
    earlier = ledger.view(without=name, where=F.col("sent_at") < times.at(asof))

    fetched = tables.staged(fetched_articles(sources, entries, pages), f"{run}/fetched")
    live = seen_set_live(before, asof, ttl)
    new = tables.staged(filter_new_articles(fetched, live, earlier), f"{run}/new")

    texts = digest_texts(new, sources, asof, topic_words=topic_words, bodies=bodies, zone=zone)
    outcomes = run_outcome(sources, fetched, new)
    outcomes.write.mode("overwrite").parquet(f"{run}/outcomes")
    tables.write_messages(digest_messages(texts, outcomes), f"{root}/messages", asof)
    tables.write_marks(marks_of(new, asof), f"{root}/marks")
    ledger.append(name, ledger_append(new, ledger.view(without=name), asof))
    ledger.fold()
