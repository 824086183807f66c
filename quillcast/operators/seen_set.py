"""The time-limited seen-set.

The time limit is on the whole set: each mark renews it for all keys, and the
set is emptied after a silence of ``ttl``. A key is therefore live if the set
was not emptied since it was marked.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillcast import fixed
from quillcast.functions import times
from quillcast.operators.caps import first_per_group
from quillcast.operators.skew import join_one


def _interval(ttl: str) -> Column:
    return F.expr(f"interval {ttl}")


def live_since(
    marks: DataFrame, asof: datetime, ttl: str = fixed.SEEN_TTL, by: list[str] | None = None
) -> DataFrame:
    """Start of the live set at ``asof``, one row per set that has one.

    Two marks less than ``ttl`` apart never have a silence between them, so
    marks are first reduced to the earliest and latest one of each span of
    ``ttl``. That is a partial aggregation however many marks a set has, and
    leaves so few rows per set that a window over them is cheap.
    """
    by = by or []
    at = times.at(asof)
    spans = (
        marks.where(F.col("marked_at") <= at)
        .groupBy(*by, F.window("marked_at", ttl).alias("span"))
        .agg(F.min("marked_at").alias("first"), F.max("marked_at").alias("last"))
    )
    before = F.lag("last").over(W.partitionBy(*by).orderBy("first"))
    starts = spans.withColumn("before", before).withColumn(
        "start",
        F.when(
            F.col("before").isNull() | (F.col("first") >= F.col("before") + _interval(ttl)),
            F.col("first"),
        ),
    )
    return (
        starts.groupBy(*by)
        .agg(F.max("start").alias("live_since"), F.max("last").alias("last_mark"))
        .where(F.col("last_mark") + _interval(ttl) > at)
    )


def seen_set_live(
    marks: DataFrame,
    asof: datetime,
    ttl: str = fixed.SEEN_TTL,
    by: list[str] | None = None,
    key: str = "url_hash",
) -> DataFrame:
    """Distinct live keys at ``asof``; ``by`` names the columns that tell sets apart.

    Only the last mark of a key counts, so marks are reduced to it before they
    meet the start of their set.
    """
    by = by or []
    at = times.at(asof)
    since = live_since(marks, asof, ttl, by)
    last = (
        marks.where(F.col("marked_at") <= at)
        .groupBy(*by, key)
        .agg(F.max("marked_at").alias("last_marked"))
    )
    if by:
        live = join_one(last, since, by, [key]).where("last_marked >= live_since")
    else:
        live = last.where(F.col("last_marked") >= since.select("live_since").scalar())
    return live.select(*by, key)


def keys_live_each(
    marks: DataFrame, asof: datetime, ttl: str = fixed.SEEN_TTL, key: str = "url_hash"
) -> DataFrame:
    """Keys live at ``asof`` if every key had a time limit of its own."""
    at = times.at(asof)
    return (
        marks.where((F.col("marked_at") <= at) & (F.col("marked_at") > at - _interval(ttl)))
        .select(key)
        .distinct()
    )


def ttl_dedup(
    arrivals: DataFrame,
    marks: DataFrame,
    asof: datetime,
    ttl: str = fixed.SEEN_TTL,
    key: str = "url_hash",
    order: str = "arrived_at",
) -> DataFrame:
    """Arrivals of one run under a time limit per key: the first one of each key that is not live.

    The batch counterpart of the streaming operator of the same purpose.
    """
    first = first_per_group(arrivals, [key], [order], 1)
    return first.join(keys_live_each(marks, asof, ttl, key), key, "left_anti")
