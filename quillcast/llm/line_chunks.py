"""Repeated passages of lines, found by windows of lines.

A passage is a run of at least two lines and ``WORDS`` words, or one line of ``LONG`` words;
words are runs of anything but white space, so blank and empty lines have none.
From every line on, the shortest passage that begins there is a window, and so is the
shortest that ends there. Any passage is covered by windows within it, and whether lines
are a window depends on them alone, so a passage that stands in two places has the same
windows in both, whatever stands around it. Windows that occur more than once anywhere are
compared byte by byte, and the lines of all but the first occurrence go, by document id
and place; of two texts under one id the one with the smaller hash is first. A line is what
goes or stays as a whole; each keeps one occurrence.

Window hashes are counted first; only windows whose hash is repeated send their text. A
passage that very many documents share is a key with many rows there: it is counted
before the shuffle, and the join back to its places is one that Spark splits.

A null text stays null and an empty one empty. Repeated rows, equal in id and text, are
treated alike, as one place. A window that overlaps its own first occurrence, as in a line
said over and over, takes only lines after that. Very long texts are taken whole. All columns
are kept, whatever their names; one called ``_removed`` is replaced. ``n_chars``, if there
is one, is counted anew. An empty table gives no rows. A document all of whose lines go
keeps its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast.llm.common import few_rows, forget, staged

WORDS = 20
LONG = 50


def chunks(text: str) -> list[tuple[int, int]]:
    """First line and end of what goes or stays as a whole: each line."""
    return [(i, i + 1) for i in range(text.count("\n") + 1)]


def spans(words: list[int]) -> list[tuple[int, int]]:
    """First line and end of each window, in order, of lines with so many words."""
    found, total, end = set(), 0, 0
    for start, own in enumerate(words):  # the shortest that begin at a line
        if own >= LONG:
            found.add((start, start + 1))
        else:
            while end < len(words) and (end < start + 2 or total < WORDS):
                total += words[end]
                end += 1
            if end >= start + 2 and total >= WORDS:
                found.add((start, end))
        if end > start:
            total -= own
        else:
            end = start + 1
    total, start = 0, 0
    for last, own in enumerate(words):  # the shortest that end at one
        total += own
        if own >= LONG:
            found.add((last, last + 1))
            continue
        while start < last - 1 and total - words[start] >= WORDS:
            total -= words[start]
            start += 1
        if start < last and total >= WORDS:
            found.add((start, last + 1))
    return sorted(found)


def windows(text: str) -> Iterator[tuple[int, int, int, str]]:
    """First line, first line that may go, end and text of each window."""
    lines = text.split("\n")
    seen: dict[int, tuple[int, int]] = {}
    for a, b in spans([len(line.split()) for line in lines]):
        window = "\n".join(lines[a:b])
        c, d = seen.setdefault(hashed(window), (a, b))
        again = c < a < d and lines[a:b] == lines[c:d]
        yield a, d if again else a, b, window


def candidates(text: str) -> Iterator[tuple[int, tuple[str, int]]]:
    """Numbers of lines that may go, each with a window it stands in and its place there."""
    for a, free, b, window in windows(text):
        for number in range(free, b):
            yield number, (window, number - a)


def hashed(window: str) -> int:
    return xxhash.xxh3_64_intdigest(window) - (1 << 63)


def without(text: str, numbers: list[int]) -> str:
    gone = set(numbers)
    return "\n".join([line for n, line in enumerate(text.split("\n")) if n not in gone])


KEYS = ["_quillcast_id", "_quillcast_text"]


def keyed(docs: DataFrame) -> DataFrame:
    """Adds the place of a row: its id, also where null, and a hash of its text."""
    return docs.withColumn("_quillcast_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn(
        "_quillcast_text", F.xxhash64("text")
    )


def window_hashes(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            places, numbers, found = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for number, (_, _, _, window) in enumerate(windows(text)):
                    places.append(i)
                    numbers.append(number)
                    found.append(hashed(window))
            ids = [batch.column(c).take(pa.array(places, pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(numbers, pa.int32()), pa.array(found, pa.int64())], [*KEYS, "number", "hash"]
            )

    texts = rows.where("text IS NOT NULL").select(*KEYS, "text")
    return texts.mapInArrow(run, "_quillcast_id string, _quillcast_text bigint, number int, hash bigint")


def window_texts(rows: DataFrame) -> DataFrame:
    """Texts of the windows whose numbers are listed, with their first line, first line that may go and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            places, lines, found, texts = [], [], [], []
            for i, (text, listed) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                listed = set(listed)
                for number, (*at, window) in enumerate(windows(text)):
                    if number in listed:
                        places.append(i)
                        lines.append(at)
                        found.append(hashed(window))
                        texts.append(window)
            ids = [batch.column(c).take(pa.array(places, pa.int64())) for c in (0, 1, 2)]
            ends = [pa.array([at[k] for at in lines], pa.int32()) for k in range(3)]
            arrays = [*ids, *ends, pa.array(found, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *KEYS, "line", "free", "stop", "hash", "window"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _quillcast_id string, _quillcast_text bigint, line int, free int, stop int, hash bigint, window string"
    return rows.select("doc_id", *KEYS, "text", "_quillcast_listed").mapInArrow(run, schema)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents without repeated passages, with ``_removed``, the numbers of lines that went.

    Sides of joins in which a passage may have very many rows are written tables, as Spark splits
    such a key where both sides come straight from a shuffle.
    """
    names = [c for c in docs.columns if c != "_removed"]
    own = {c: f"_kept_{i}" for i, c in enumerate(names) if c not in ("doc_id", "text")}
    rows = keyed(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(other) for c, other in own.items()]))
    hashes = staged(window_hashes(rows), folder, "hashes")
    repeated = staged(hashes.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), folder, "repeated")
    found = hashes.join(repeated, "hash", "left_semi")
    listed = found.groupBy(*KEYS).agg(F.collect_set("number").alias("_quillcast_listed"))
    marked = staged(rows.join(listed, KEYS, "left"), folder, "marked")
    forget(spark, folder, "hashes", "repeated")
    suspects = marked.where("_quillcast_listed IS NOT NULL")
    texts = staged(window_texts(suspects.dropDuplicates(KEYS)), folder, "texts")
    place = F.struct("doc_id", "_quillcast_text", "line")
    first = texts.groupBy("hash", "window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = staged(first.drop("n"), folder, "first")
    later = texts.join(first, ["hash", "window"]).where(~place.eqNullSafe(F.col("first")) & (F.col("free") < F.col("stop")))
    lines = F.explode(F.sequence("free", F.col("stop") - 1)).alias("number")
    gone = later.select(*KEYS, lines).groupBy(*KEYS).agg(F.array_sort(F.collect_set("number")).alias("_removed"))
    gone = staged(gone, folder, "gone")
    forget(spark, folder, "texts", "first")
    untouched = marked.where("_quillcast_listed IS NULL").withColumn("_removed", F.lit(None).cast("array<int>"))
    cleaned = cut(suspects.join(gone, KEYS, "left"))
    done = untouched.unionByName(cleaned)
    columns = {c: F.col(own.get(c, c)).alias(c) for c in names}
    if "n_chars" in names:
        kind, was = docs.schema["n_chars"].dataType, F.col(own["n_chars"])
        told = F.when(F.col("_removed").isNull(), was).otherwise(F.length("text").cast(kind))
        columns["n_chars"] = told.alias("n_chars")
    return done.select(*columns.values(), "_removed")


def cut(rows: DataFrame) -> DataFrame:
    """Rows without their removed lines."""
    names = rows.columns
    at, removed = names.index("text"), names.index("_removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            pairs = zip(batch.column(at).to_pylist(), batch.column(removed).to_pylist())
            texts = [without(t, r) if r else t for t, r in pairs]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema)
