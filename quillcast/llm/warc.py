"""Web archives: written from pages, and read back by verified boundaries.

Writing is Spark's text writer with a blank line between records. Reading cuts files
at the record magic, also where a payload happens to hold it, so that any split of a
file can be read by itself. Each cut is only a candidate record. It tells where its
successor must begin: its own place plus header, content length and blank line.
Starting from the beginning of a file, only candidates on that chain are records.

The chain is followed by pointer jumping: neighbours of which one is the other's
successor form runs (usually a whole split), and each round doubles the number of
runs that one jump covers. Payloads never take part in it.

A null payload is empty. A page without id gets a response without record id. A null
url is left out, line ends in it are escaped. Repeated rows get a record each; equal
rows with the largest id are all responses. A file must begin with a record; what
follows a record that is cut off or broken is lost, as no chain leads there. An empty
folder or table gives no rows. Further columns of the pages are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from quillcast.llm.common import forget, staged

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
RECORDS_PER_FILE = 100_000


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: eight times five hex digits make four letters each."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Id and digest of pages of which another has the payload, with the id of that one."""
    keyed = pages.select("page_id", "payload_digest").where(F.octet_length("payload") >= min_bytes)
    shared = (
        keyed.groupBy("payload_digest")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return keyed.join(shared, "payload_digest").where("page_id != refers_to").dropDuplicates(["page_id", "payload_digest"])


def write_warc(pages: DataFrame, path: str, folder: str, min_bytes: int = 0, date: str = "2025-01-01T00:00:00Z") -> None:
    """Write a record per page (``page_id, url, html``) to text files of records.

    ``folder`` takes the list of revisits. It is written first: its size is known then,
    and only a long list makes Spark shuffle the payloads.
    """
    pages = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("payload_digest", base32_sha1(F.col("payload")))
    listed = staged(revisits(pages, min_bytes), folder, "revisits")
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.lit("")).otherwise(F.concat(F.lit(HTTP + END), F.col("payload").cast("string")))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    (
        pages.join(listed, ["page_id", "payload_digest"], "left")
        .withColumn("block", block)
        .select(F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(END), F.col("block")).alias("value"))
        .write.option("lineSep", END)
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )
    forget(pages.sparkSession, folder, "revisits")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, with file, split and order within the split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
        (F.octet_length("value") + len(MAGIC)).cast("bigint").alias("size"),
        "value",
    )


def field(header: Column, name: str, value: str) -> Column:
    return F.nullif(F.regexp_extract(header, f"(?im)^{name}:[ \\t]*{value}[ \\t]*\\r?$", 1), F.lit(""))


def parsed(cut: DataFrame) -> DataFrame:
    """Adds header fields, the record's whole length, and the payload's size and digest.

    The last two are null where the content is shorter than the record.
    """
    gap = f"{len(END)} + 1"
    return (
        cut.withColumn("head", F.substring_index("value", END, 1))
        .withColumn("length", field(F.col("head"), "Content-Length", "0*(\\d{1,18})").cast("bigint"))
        .withColumn("record", F.lit(len(MAGIC) + 2 * len(END)) + F.octet_length("head") + F.col("length"))
        .withColumn(
            "block",
            F.when(
                F.col("record") <= F.col("size"),
                F.expr(f"substring(cast(value AS binary), octet_length(head) + {gap}, cast(length AS int))"),
            ),
        )
        .withColumn("http", F.substring_index(F.col("block").cast("string"), END, 1))
        .withColumn("payload", F.expr(f"substring(block, octet_length(http) + {gap})"))
        .select(
            "file",
            "split",
            "place",
            "size",
            "record",
            field(F.col("head"), "WARC-Type", "(\\S+)").alias("record_type"),
            field(F.col("head"), "WARC-Record-ID", "<urn:page:(-?\\d+)>").cast("bigint").alias("page_id"),
            field(F.col("head"), "WARC-Refers-To", "<urn:page:(-?\\d+)>").cast("bigint").alias("refers_to"),
            field(F.col("head"), "WARC-Payload-Digest", "sha1:(\\w+)").alias("said"),
            F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            base32_sha1(F.col("payload")).alias("payload_digest"),
        )
    )


def in_split(*frame: int) -> WindowSpec:
    window = Window.partitionBy("file", "split").orderBy("place")
    return window.rowsBetween(Window.unboundedPreceding, *frame) if frame else window


def located(cut: DataFrame) -> DataFrame:
    """Adds the byte of the file at which the magic of each piece stands.

    Pieces cover a file without gaps, so sizes before a piece add up to its place:
    first within the split, then over the splits of the file.
    """
    before = F.coalesce(F.sum("size").over(in_split(-1)), F.lit(0))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = cut.groupBy("file", "split").agg(F.sum("size").alias("total"))
    splits = splits.select("file", "split", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = cut.withColumn("before", before).join(splits, ["file", "split"])
    return placed.withColumn("offset", F.col("base") + F.col("before") - len(MAGIC)).drop("base", "before")


def with_runs(candidates: DataFrame) -> DataFrame:
    """Adds the run of each candidate: the offset of its first one."""
    following = F.lag("next").over(in_split()).eqNullSafe(F.col("offset"))
    return (
        candidates.withColumn("next", F.col("offset") + F.col("record"))
        .withColumn("first", F.when(~following, F.col("offset")))
        .withColumn("run", F.last("first", ignorenulls=True).over(in_split(0)))
        .drop("first")
    )


def reached(candidates: DataFrame, folder: str) -> DataFrame:
    """The candidates on the chain from the beginning of their file (columns of ``with_runs``)."""
    spark = candidates.sparkSession
    tails = candidates.groupBy("file", "run").agg(F.max_by("next", "offset").alias("to"))
    targets = candidates.select("file", F.col("offset").alias("to"), F.col("run").alias("to_run"))
    jumps = staged(tails.join(targets, ["file", "to"]).select("file", "run", "to_run", "to"), folder, "jumps0")
    on_chain = candidates.where("offset = 0").select("file", "run", F.col("offset").alias("entry"))
    longest = jumps.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for k in range(math.ceil(math.log2(longest + 1))):
        ahead = on_chain.join(jumps, ["file", "run"]).select("file", F.col("to_run").alias("run"), F.col("to").alias("entry"))
        on_chain = staged(on_chain.unionByName(ahead), folder, f"chain{k + 1}")
        second = jumps.select("file", F.col("run").alias("to_run"), F.col("to_run").alias("r"), F.col("to").alias("t"))
        twice = jumps.join(second, ["file", "to_run"]).select("file", "run", F.col("r").alias("to_run"), F.col("t").alias("to"))
        jumps = staged(twice, folder, f"jumps{k + 1}")
        forget(spark, folder, f"chain{k}", f"jumps{k}")
    return candidates.join(on_chain, ["file", "run"]).where("offset >= entry").drop("entry")


def reassembled(spark: SparkSession, path: str, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Records whose payload holds the magic, put together from their pieces.

    Only files with such records are read again. Each piece belongs to the last record
    that begins at it or before it.
    """
    broken = records.where("record > size").select("file", "offset", "record")
    files = broken.select("file").distinct()
    in_file = Window.partitionBy("file").orderBy("offset")
    starts = records.join(files, "file", "left_semi").select("file", "offset", F.lit(True).alias("starts"))
    owned = (
        candidates.join(files, "file", "left_semi")
        .select("file", "offset")
        .join(starts, ["file", "offset"], "left")
        .withColumn("owner", F.last(F.when(F.col("starts"), F.col("offset")), ignorenulls=True).over(in_file))
        .join(broken.select("file", F.col("offset").alias("owner")), ["file", "owner"], "left_semi")
        .select("file", "offset", "owner")
    )
    texts = located(pieces(spark, path).join(files, "file", "left_semi"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC)
    return (
        texts.join(owned, ["file", "offset"])
        .groupBy("file", F.col("owner").alias("offset"))
        .agg(joined.alias("value"))
        .withColumn("size", (F.octet_length("value") + len(MAGIC)).cast("bigint"))
        .withColumn("split", F.lit(0))
        .withColumn("place", F.lit(0))
    )


def read_warc(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The records of all archives in ``path``, as ``SCHEMA`` says."""
    placed = located(parsed(pieces(spark, path))).where("offset >= 0")
    candidates = staged(with_runs(placed), folder, "candidates")
    records = staged(reached(candidates, folder), folder, "records")
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "said"]
    found = records.where("record <= size").select(fields)
    if not records.where("record > size").isEmpty():
        again = parsed(reassembled(spark, path, candidates, records)).where("record <= size").select(fields)
        found = staged(found.unionByName(again), folder, "found")
    is_revisit = F.lower("record_type") == "revisit"
    responses = found.where(~is_revisit)
    sizes = responses.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("said")).agg(
        F.max("payload_bytes").alias("payload_bytes")
    )
    visits = found.where(is_revisit).drop("payload_bytes", "payload_digest").join(sizes, ["refers_to", "said"], "left")
    visits = visits.withColumn("payload_digest", F.col("said"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return responses.select(names).unionByName(visits.select(names))
