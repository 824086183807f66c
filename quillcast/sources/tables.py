"""Tables a job keeps between runs: ledger, marks, run results and messages.

All are Parquet folders under one root in shared storage. Appends are anti-join
plus write, so no table format beyond Parquet is needed. The ledger is a kept log,
which stays cheap to look up and small in files however many runs add to it.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillcast import schemas
from quillcast.sources.kept import KeptLog


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables that every executor sees.

    This is what the cluster names in ``spark.checkpoint.dir``. A local session that
    names none gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillcast-"))
        folder = sc.getCheckpointDir()
    return folder


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A kept table, empty before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], StructType.fromDDL(schema))


def staged(df: DataFrame, path: str) -> DataFrame:
    """The rows as a written table, for plans that use them more than once.

    It cuts the lineage, so lost executors cost no more than a re-read.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ledger_of(spark: SparkSession, root: str, buckets: int = 64) -> KeptLog:
    """The ledger under the root of a digest: one memory for its jobs and streams."""
    return KeptLog(spark, f"{root}/ledger", schemas.LEDGER, ["url_hash"], buckets)


def read_daily_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.LEDGER)


def write_daily_ledger(rows: DataFrame, path: str) -> None:
    """A copy of ledger rows with one folder per day sent, for reports on days."""
    rows.write.mode("append").partitionBy("sent_date").parquet(path)


def write_messages(messages: DataFrame, path: str, sent_at: datetime, run: str | None = None) -> None:
    """Write the messages of a run, in sending order within each digest.

    A repeated run replaces its own folder; a run without a name has its time.
    """
    (
        messages.withColumn("digest_date", F.lit(sent_at.date()))
        .withColumn("run", F.lit(run or f"{sent_at:%H%M%S}"))
        .repartition("digest_id")
        .sortWithinPartitions("digest_id", "chunk_no")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("digest_date", "run")
        .parquet(path)
    )


def write_marks(marks: DataFrame, path: str) -> None:
    """Add the marks of a run; a repeated run replaces the folder of its own time."""
    (
        marks.withColumn("run", F.date_format("marked_at", "yyyyMMdd'T'HHmmss"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run")
        .parquet(path)
    )
