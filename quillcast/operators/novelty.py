"""Which articles were sent before, and recording the ones that are sent.

The ledger only grows, while a run brings few articles for each source. So the
run's distinct keys are looked up in the ledger first. That scans
one column of the ledger and, where the keys are few enough for Spark to
broadcast them, never shuffles it. The articles are then anti-joined with the
hits alone. Distinct keys are found before any shuffle, so a URL that fills a
third of the run costs one row per map task.

Tables seen before are DataFrames, or views of a kept log (``sources.kept``). The base of
a log is bucketed by the key, so only the keys are shuffled to meet it, and a Bloom filter
of the keys leaves out most of it as it is scanned.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcast.functions import times
from quillcast.operators.bloom import BITS, bloom_filter, may_hold
from quillcast.operators.caps import first_per_group
from quillcast.operators.skew import salt
from quillcast.sources.kept import View

KEY = "url_hash"


def base_hits(keys: DataFrame, log: View, bits: int | None = BITS) -> DataFrame:
    """Those of the distinct ``keys`` that a log's base holds; it is not shuffled for that.

    Keys are dealt into as many partitions as there are buckets, as Spark would otherwise
    shuffle both sides where it is set to more partitions. ``bits`` sizes the Bloom filter
    that is applied first; None goes without one.
    """
    known = log.base.select(KEY)
    if bits is not None:
        known = known.where(may_hold(bloom_filter(keys, KEY, bits), KEY, bits))
    return known.join(keys.repartition(log.buckets, KEY), KEY)


def _hits(keys: DataFrame, *seen: DataFrame | View) -> DataFrame:
    """Those of the distinct ``keys`` that one of the tables holds.

    Keys are distinct, so an inner join selects like a semi-join; unlike that it
    is not pushed into each of the tables with a copy of the keys.
    """
    plain = [s.parts if isinstance(s, View) else s for s in seen]
    known = reduce(DataFrame.unionByName, (s.select(KEY) for s in plain))
    logs = [s for s in seen if isinstance(s, View) and s.base is not None]
    found = [known.join(keys, KEY), *(base_hits(keys, log) for log in logs)]
    return reduce(DataFrame.unionByName, found).distinct()


def _unseen(articles: DataFrame, *seen: DataFrame | View) -> DataFrame:
    """Articles without a hit.

    A hot URL is looked up once for each salt it occurs with, and its articles
    meet the hit of their own salt. An anti-join would be pushed into every
    branch the articles are a union of, each time with a copy of the lookup; an
    outer join stays in one place.
    """
    salted = articles.withColumn("_salt", salt("source_id", "position"))
    hits = _hits(salted.select(KEY, "_salt").distinct(), *seen).withColumn("_seen", F.lit(True))
    return salted.join(hits, [KEY, "_salt"], "left").where("_seen is null").drop("_seen", "_salt")


def anti_seen_set(articles: DataFrame, live_marks: DataFrame) -> DataFrame:
    """Articles that are not in the live seen-set."""
    return _unseen(articles, live_marks)


def anti_ledger(articles: DataFrame, ledger: DataFrame | View) -> DataFrame:
    """Articles that are not in the permanent ledger."""
    return _unseen(articles, ledger)


def filter_new_articles(articles: DataFrame, live_marks: DataFrame, ledger: DataFrame | View) -> DataFrame:
    """Articles in neither; both are looked up at once, so articles are joined once."""
    return _unseen(articles, live_marks, ledger)


def sent_hashes(hashes: DataFrame, ledger: DataFrame | View) -> DataFrame:
    """Those of the given keys that the ledger holds."""
    return _hits(hashes.select(KEY).distinct(), ledger)


def dedup_funnel(articles: DataFrame, live_marks: DataFrame, ledger: DataFrame | View) -> DataFrame:
    """One row: articles in, left after the seen-set, left after the ledger."""
    per_key = articles.groupBy(KEY).agg(F.count("*").alias("n"))
    keys = per_key.select(KEY)
    in_set = _hits(keys, live_marks).withColumn("in_set", F.lit(True))
    in_ledger = _hits(keys, ledger).withColumn("in_ledger", F.lit(True))
    after_set = F.when(F.col("in_set").isNull(), F.col("n")).otherwise(0)
    after_ledger = F.when(
        F.col("in_set").isNull() & F.col("in_ledger").isNull(), F.col("n")
    ).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (
        per_key.join(in_set, KEY, "left")
        .join(in_ledger, KEY, "left")
        .agg(
            total("n").alias("n_in"),
            total(after_set).alias("n_after_set"),
            total(after_ledger).alias("n_after_ledger"),
        )
    )


def ledger_append(new: DataFrame, ledger: DataFrame | View, sent_at: datetime) -> DataFrame:
    """Rows the ledger gains: one for each key it lacks, of the first article with it."""
    first = first_per_group(new, [KEY], ["source_id", "position"], 1)
    return anti_ledger(first, ledger).select(
        KEY,
        F.coalesce("title", F.lit("")).alias("title"),
        "source_id",
        times.at(sent_at).alias("sent_at"),
        F.lit(sent_at.date()).alias("sent_date"),
    )


def marks_of(new: DataFrame, sent_at: datetime) -> DataFrame:
    """Marks the seen-set gains from a run."""
    return new.select(KEY).distinct().withColumn("marked_at", times.at(sent_at))
