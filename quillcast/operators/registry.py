"""The source registry, kept as a table plus a log of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillcast import fixed
from quillcast.functions import times
from quillcast.functions.text import escape_markup
from quillcast.functions.times import is_time_of_day
from quillcast.functions.urls import is_web_url
from quillcast.operators.caps import first_per_group
from quillcast.sources import tables


def default_sources(spark: SparkSession) -> DataFrame:
    rows = [(i, *row, True) for i, row in enumerate(fixed.DEFAULT_SOURCES, 1)]
    return spark.createDataFrame(
        rows, "source_id bigint, name string, url string, type string, active boolean"
    )


def active_sources(registry: DataFrame) -> DataFrame:
    keep = [c for c in ("source_id", "digest_id", "name", "url", "type") if c in registry.columns]
    return registry.where("active").select(*keep)


def all_sources(registry: DataFrame) -> DataFrame:
    return registry.orderBy("source_id")


def registry_lines(registry: DataFrame) -> DataFrame:
    """One display line per source, active or not."""
    mark = F.when(F.col("active"), "✅").otherwise("❌")
    line = F.format_string(fixed.SOURCE_LINE, mark, "source_id", "name", "type")
    return registry.select("source_id", escape_markup(line).alias("line"))


def seed_if_empty(registry: DataFrame, defaults: DataFrame) -> DataFrame:
    """The registry, or the defaults where it has no row."""
    return registry.unionByName(defaults.where(~registry.exists()))


def parse_registrations(lines: DataFrame) -> DataFrame:
    """Registration lines (seq, line) as url, name and type.

    The last word is the type if it is one, else the type is ``rss``. A line of
    fewer than two words gives nulls.
    """
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    last = F.lower(F.element_at("w", -1))
    typed = last.isin("rss", "crawl")
    n = F.size("w")
    name = F.when(
        typed & (n > 2), F.array_join(F.slice("w", F.lit(2), F.greatest(n - 2, F.lit(0))), " ")
    ).otherwise(F.array_join(F.slice("w", F.lit(2), F.greatest(n - 1, F.lit(0))), " "))
    enough = n >= 2
    return lines.withColumn("w", words).select(
        "seq",
        F.when(enough, F.get("w", F.lit(0))).alias("url"),
        F.when(enough, name).alias("name"),
        F.when(enough, F.when(typed, last).otherwise("rss")).alias("type"),
    )


def dense_number(df: DataFrame, order: str, name: str, folder: str | None = None) -> DataFrame:
    """Number rows from 1 by a distinct column, dense or sparse: a prefix sum over range partitions.

    Rows are dealt into ranges of the column and written, below ``folder`` or in the shared
    folder, so that counting and ranking see the same ranges. Ranges are ranked each by itself
    and shifted by the sizes of those before, which is one row for each range.
    """
    part = F.spark_partition_id()
    ranged = df.repartitionByRange(order).withColumn("_part", part)
    ranged = tables.staged(ranged, f"{folder or tables.scratch(df.sparkSession)}/ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    shift = F.sum("_size").over(W.orderBy("_part")) - F.col("_size")
    shifts = sizes.select("_part", shift.alias("_shift"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(order))
    ranked = ranged.withColumn("_inside", inside).join(shifts, "_part")
    return ranked.withColumn(name, F.col("_shift") + F.col("_inside")).drop("_part", "_shift", "_inside")


def _added(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """The lines that add a source, with its new id."""
    valid = parse_registrations(lines).where(F.col("url").isNotNull() & is_web_url("url"))
    fresh = first_per_group(valid, ["url"], ["seq"], 1).join(
        registry.select("url"), "url", "left_anti"
    )
    top = registry.agg(F.coalesce(F.max("source_id"), F.lit(0))).scalar()
    return dense_number(fresh, "seq", "_n").withColumn(
        "source_id", (top + F.col("_n")).cast("bigint")
    )


def add_sources(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources the registration lines add, with new ids in line order.

    The first line with a URL wins, and a URL the registry holds is not added
    again nor made active.
    """
    return _added(lines, registry).select(
        "source_id", "name", "url", "type", F.lit(True).alias("active")
    )


def registration_results(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """What comes of each registration line: its outcome, and the id of an added source."""
    ids = _added(lines, registry).select("seq", "source_id")
    outcome = (
        F.when(F.col("url").isNull(), "usage")
        .when(~is_web_url("url"), "invalid")
        .when(F.col("source_id").isNull(), "duplicate")
        .otherwise("added")
    )
    return (
        parse_registrations(lines)
        .join(ids, "seq", "left")
        .select("seq", outcome.alias("outcome"), "source_id")
    )


def parse_switches(lines: DataFrame) -> DataFrame:
    """Switch lines (seq, ts, action, id_text) whose id is a number, as mutations."""
    digits = F.col("id_text").rlike("^[0-9]+$")
    return (
        lines.where(digits)
        .withColumn("source_id", F.col("id_text").try_cast("bigint"))
        .where("source_id is not null")
        .drop("id_text")
    )


def registry_state(registry: DataFrame, mutations: DataFrame) -> DataFrame:
    """The registry after the enable and disable mutations; the last one of a source counts."""
    last = mutations.groupBy("source_id").agg(
        F.max_by("action", F.struct("ts", "seq")).alias("_action")
    )
    active = F.coalesce(F.col("_action") == "enable", F.col("active"))
    return (
        registry.join(last, "source_id", "left")
        .withColumn("active", active)
        .select(*registry.columns)
    )


def unknown_mutations(registry: DataFrame, mutations: DataFrame) -> DataFrame:
    """Mutations of ids the registry does not hold."""
    return mutations.join(registry.select("source_id"), "source_id", "left_anti")


def valid_times(lines: DataFrame, text: str = "time_text") -> DataFrame:
    """Lines whose time of day is well formed and in range."""
    return lines.where(is_time_of_day(text))


def settings_latest(log: DataFrame) -> DataFrame:
    """The value written last for each key."""
    return log.groupBy("key").agg(F.max_by("value", F.struct("updated_at", "seq")).alias("value"))


def get_settings(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Values of the wanted settings (key, default), or the default where none was written."""
    asked = log.join(wanted.select("key"), "key", "left_semi")
    return wanted.join(settings_latest(asked), "key", "left").select(
        "key", F.coalesce("value", "default").alias("value")
    )


def upsert_setting(log: DataFrame, key: str, value: str, updated_at, seq: int) -> DataFrame:
    """The log with one more write."""
    spark = log.sparkSession
    row = spark.range(1).select(
        F.lit(key).alias("key"),
        F.lit(value).alias("value"),
        times.at(updated_at).alias("updated_at"),
        F.lit(seq).cast("bigint").alias("seq"),
    )
    return log.unionByName(row)
