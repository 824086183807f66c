"""The time-limited seen-set as a stream.

A set lives from a first mark until a silence of ``ttl``; each mark renews it for all of its
keys. Two things follow a stream of marks:

* ``lives_stream`` gives each life once it has ended, by a session window: Spark drops the
  state of a set when the watermark passes its silence.
* ``SeenSet`` keeps what a look-up needs in tables: the lives that may still change, a row
  each, and the last mark of every key in them. A micro-batch reduces its marks to
  the first and last of each span of ``ttl`` and to one row a key before any shuffle, so
  a set with a third of all marks is no more than a few rows.

Marks may come late by ``late`` behind the newest one; those that come later still are left
out, as they are by Spark's own operators. A late mark may join two lives into one again, so
ended lives stay until no mark can.
"""

from __future__ import annotations

from copy import copy
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillcast import fixed
from quillcast.functions import times
from quillcast.operators.skew import join_one
from quillcast.sources import folders, tables
from quillcast.sources.kept import KeptLog


def lives_stream(
    marks: DataFrame, ttl: str = fixed.SEEN_TTL, by: list[str] | None = None, late: str = "0 seconds"
) -> DataFrame:
    """Lives that have ended: ``by``, first and last mark, when the set was emptied, number of marks.

    Marks of a session are merged in each task first with
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``.
    """
    by = by or []
    apart = by or ["_set"]
    events = marks.withColumn("_set", F.lit(0)).select(*apart, times.instant("marked_at").alias("at"))
    lives = (
        events.withWatermark("at", late)
        .groupBy(F.session_window("at", ttl).alias("life"), *apart)
        .agg(F.max("at").alias("last"), F.count("*").alias("n_marks"))
    )
    return lives.select(
        *by,
        times.utc("life.start").alias("first_mark"),
        times.utc("last").alias("last_mark"),
        times.utc("life.end").alias("emptied_at"),
        "n_marks",
    )


class SeenSet:
    """The sets that a stream of marks keeps under ``root``; ``by`` (as DDL) tells sets apart."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        by: str = "",
        ttl: str = fixed.SEEN_TTL,
        late: str = "0 seconds",
        key: str = "url_hash",
        buckets: int = 64,
    ):
        self.spark, self.root, self.key = spark, root, key
        self.by = StructType.fromDDL(by).names if by else []
        self.ttl, self.late = F.expr(f"interval {ttl}"), F.expr(f"interval {late}")
        self.span = ttl
        columns = f"{by}, " if by else ""
        self.lives_schema = f"{columns}first timestamp_ntz, last timestamp_ntz"
        schema = f"{columns}{key} string, last_marked timestamp_ntz"
        self.keys = KeptLog(spark, f"{root}/keys", schema, [*self.by, key], buckets, self._worth_keeping)

    def on(self, session: SparkSession) -> SeenSet:
        """The same tables, read and written by another session."""
        other, other_keys = copy(self), copy(self.keys)
        other.spark, other.keys = session, other_keys
        other_keys.spark, other_keys.reduce = session, other._worth_keeping
        return other

    def lives(self, before: int | None = None) -> DataFrame:
        """Lives that may still change, after the last batch or the last one before a number."""
        done = [
            n for n in folders.names(self.spark, f"{self.root}/lives")
            if (before is None or int(n) < before) and folders.complete(self.spark, f"{self.root}/lives/{n}")
        ]
        if not done:
            return self.spark.createDataFrame([], StructType.fromDDL(self.lives_schema))
        return self.spark.read.schema(self.lives_schema).parquet(f"{self.root}/lives/{done[-1]}")

    def _open(self, lives: DataFrame) -> Column:
        """The time that a mark must have to count, null before the first one."""
        return lives.agg(F.max("last") - self.late).scalar()

    def _merged(self, spans: DataFrame) -> DataFrame:
        """Spans less than ``ttl`` apart as one; a set has few of them."""
        apart = W.partitionBy(*self.by) if self.by else W.partitionBy(F.lit(0))
        order = apart.orderBy("first", "last")
        before = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
        starts = F.when(before.isNull() | (F.col("first") >= before + self.ttl), 1).otherwise(0)
        told = spans.withColumn("_starts", starts).withColumn("_life", F.sum("_starts").over(order))
        merged = told.groupBy(*self.by, "_life").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        return merged.drop("_life")

    def update(self, marks: DataFrame, batch_id: int) -> None:
        """Take in the marks of a batch; a batch that is taken in again changes nothing."""
        before = self.lives(batch_id)
        open_ = self._open(before)
        fresh = marks.where(open_.isNull() | (F.col("marked_at") >= open_))
        spans = (
            fresh.groupBy(*self.by, F.window("marked_at", self.span).alias("_span"))
            .agg(F.min("marked_at").alias("first"), F.max("marked_at").alias("last"))
            .drop("_span")
        )
        folder = f"{self.root}/lives/{batch_id:012d}"
        merged = tables.staged(self._merged(before.unionByName(spans)), f"{self.root}/merged/{batch_id:012d}")
        merged.where(F.col("last") + self.ttl > self._open(merged)).write.mode("overwrite").parquet(folder)
        last = fresh.groupBy(*self.by, self.key).agg(F.max("marked_at").alias("last_marked"))
        self.keys.append(f"batch-{batch_id:012d}", last)
        self.keys.fold()
        for kind in ("lives", "merged"):
            for old in folders.names(self.spark, f"{self.root}/{kind}"):
                if int(old) < batch_id - 1:
                    folders.delete(self.spark, f"{self.root}/{kind}/{old}")

    def _of_lives(self, keys: DataFrame, since: DataFrame) -> DataFrame:
        """Last marks of keys that are not older than ``since`` of their set."""
        last = keys.groupBy(*self.by, self.key).agg(F.max("last_marked").alias("last_marked"))
        if self.by:
            kept = join_one(last, since, self.by, [self.key]).where("last_marked >= since")
        else:
            kept = last.where(F.col("last_marked") >= since.select("since").scalar())
        return kept.select(*self.by, self.key, "last_marked")

    def _worth_keeping(self, keys: DataFrame) -> DataFrame:
        return self._of_lives(keys, self.lives().groupBy(*self.by).agg(F.min("first").alias("since")))

    def live(self, asof: datetime) -> DataFrame:
        """Distinct live keys at a time that is not before the newest mark."""
        newest = self.lives().groupBy(*self.by).agg(F.max_by(F.struct("first", "last"), "first").alias("_l"))
        since = newest.where(F.col("_l.last") + self.ttl > times.at(asof))
        since = since.select(*self.by, F.col("_l.first").alias("since"))
        return self._of_lives(self.keys.read(), since).drop("last_marked")


def seen_stream(marks: DataFrame, seen: SeenSet) -> StreamingQuery:
    """Take in all marks that have landed, a micro-batch after the other."""
    return (
        marks.writeStream.foreachBatch(lambda batch, batch_id: seen.on(batch.sparkSession).update(batch, batch_id))
        .option("checkpointLocation", f"{seen.root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
