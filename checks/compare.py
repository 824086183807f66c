"""Run queries next to their SQL and report differences: ``python -m checks.compare [names]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def rows(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of texts, columns by name."""
    df = df[sorted(df.columns)]
    cells = df.astype(object).where(df.notna(), None)
    return sorted((tuple(map(str, r)) for r in cells.itertuples(index=False)))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> str:
    """Empty if both results are equal, else what differs."""
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        return ""
    want = con.execute(ORACLES[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return f"{len(a)} against {len(b)} rows; {only_a} against {only_b}"


def main() -> None:
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", os.environ.get("SESSION_ZONE", "UTC"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in sys.argv[1:] or QUERIES:
        start = time.time()
        try:
            found = difference(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(found)
        n = len(QUERIES)
        print(f"{'DIFF' if found else 'ok  '} {name} {time.time() - start:.1f}s {found[:1800]}", flush=True)
    print(f"{bad} differ of {len(sys.argv[1:]) or n}; {len(ORACLES)} with SQL")


if __name__ == "__main__":
    main()
