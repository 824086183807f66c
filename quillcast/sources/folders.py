"""Names, marks and small texts in shared storage, through the file system that Spark uses."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder in order, without hidden ones; none where there is no folder."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return []
    found = [status.getPath().getName() for status in fs.listStatus(place)]
    return sorted(n for n in found if not n.startswith((".", "_")))


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end."""
    fs, place = _place(spark, f"{path}/_SUCCESS")
    return fs.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that doesn't exist yet; False if another writer was first."""
    fs, place = _place(spark, path)
    try:
        out = fs.create(place, False)
    except Py4JJavaError as e:
        if "exist" not in str(e.java_exception.getMessage()).lower():
            raise
        return False
    out.write(text.encode())
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _place(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
