"""Joins in which one key may have a large share of the rows.

Run-time skew handling splits a hot key only where both join sides come straight
from a shuffle. Sides here are often partitioned by an earlier step already, so
hot keys are split by hand. Salts are hashes of the row, hence the same when a
task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 256
HOT = 64  # a key is hot if it has more than one in so many rows, so there are fewer than that
TRACKED = 4096  # keys that the search for hot ones keeps in mind at once


def salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def hot_keys(rows: DataFrame, on: list[str]) -> Column:
    """Hashes of the keys with more than one in ``HOT`` of the rows, as one array.

    A sketch of frequent items finds them in one pass over the key columns, with a state of
    fixed size and without a shuffle of the keys. It may name a key that is not quite hot,
    but misses none: its counts are never too low by more than one in ``TRACKED`` rows.
    """
    items = F.expr(f"approx_top_k(xxhash64({', '.join(f'`{c}`' for c in on)}), {2 * HOT}, {TRACKED})")
    told = rows.agg(items.alias("items"), F.count("*").alias("n"))
    # counts of the sketch are upper bounds
    hot = F.filter("items", lambda x: x["count"] * HOT > F.col("n"))
    return told.select(F.transform(hot, lambda x: x["item"]).alias("hot")).scalar()


def join_one(rows: DataFrame, per_key: DataFrame, on: list[str], spread_by: list[str]) -> DataFrame:
    """Inner join with a table that has one row per key; rows of a hot key are spread.

    Only the rows of hot keys are copied for each salt, so the table grows by less than
    ``HOT * SALTS`` rows, and not at all where no key is hot.
    """
    is_hot = F.array_contains(hot_keys(rows, on), F.xxhash64(*on))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = per_key.withColumn("_salt", F.explode(salts))
    spread = rows.withColumn("_salt", F.when(is_hot, salt(*spread_by)).otherwise(0))
    return spread.join(copies, [*on, "_salt"]).drop("_salt")
