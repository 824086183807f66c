"""Benchmark passages in documents, also with some words exchanged: spaced-seed hashing.

A mask names the words of a span that count; the others may be anything. Every span of
every document is hashed under each mask and met with those of the benchmark. Around a
hit the words of both are compared: an item leaks where ``WINDOW`` words in a row
agree but for ``EXCHANGED`` of them. Any two exchanged words in such a window leave at
least one mask untouched, so the masks miss none. Items shorter than the window must
stand there whole and without exchange.

All is DataFrame operations over arrays of word hashes; only hits leave a task.
Benchmark hashes are broadcast in blocks of at most about ``BLOCK`` rows, a few dozen MB; a
larger benchmark takes several passes over the documents.

Words are runs of letters and digits in lower case. Null and empty texts, and items of
fewer words than a span, match nothing. Repeated documents or items give a row for each
pair of ids. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcast.llm.common import staged

MASKS = ((0, 1, 2, 3, 5, 8, 9, 10), (0, 2, 3, 4, 6, 7, 8, 10), (0, 1, 4, 5, 6, 7, 9, 10))
SPAN = 11
WINDOW = 15
EXCHANGED = 2
BLOCK = 200_000
BUCKETS = 1 << 20  # of ids; some 20 MB where all are marked


def word_hashes(text: str) -> Column:
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, words: Column, *kept: str) -> DataFrame:
    """``kept``, place and seed: a row for each place and mask of each row with room for a span.

    Places are exploded first, so that seeds are hashed in generated code instead of a lambda.
    Rows given on carry no texts, however many places a text has. The outer forms keep Spark from
    testing for empty arrays below, which would hash every text twice; rows without a place
    have no seed and meet nothing.
    """
    starts = F.when(F.size(words) >= SPAN, F.slice(words, F.lit(1), F.greatest(F.size(words) - (SPAN - 1), F.lit(0))))
    placed = rows.select(*kept, words.alias("_words"), F.posexplode_outer(starts).alias("at", "_first"))
    word = lambda o: F.get("_words", F.col("at") + o) if o else F.col("_first")
    of_masks = F.array(*[F.xxhash64(F.lit(m), *map(word, mask)) for m, mask in enumerate(MASKS)])
    return placed.select(*kept, "at", F.explode_outer(F.when(F.col("at").isNotNull(), of_masks)).alias("seed"))


def context(at: Column) -> Column:
    """First of the item's words that windows around a hit may hold."""
    return F.greatest(at - (WINDOW - SPAN), F.lit(0))


def item_seeds(items: DataFrame) -> DataFrame:
    """Seeds of items with the few words around each, so that a row has a bounded size."""
    near = F.slice("item_words", context(F.col("at")) + 1, F.lit(2 * WINDOW - SPAN))
    size = F.size("item_words").alias("item_size")
    placed = seeds(items, F.col("item_words"), "item_id", "item_words")
    return placed.select("seed", "item_id", F.col("at").alias("item_at"), size, near.alias("near"))


def verified(hits: DataFrame) -> DataFrame:
    """Hits in a window of enough agreement, with the words that agree in the best one.

    Windows hold the span of the hit and stay within both texts; of an item shorter than a
    window the only one is the whole item.
    """
    at, item_at, words = F.col("at"), F.col("item_at"), F.col("words")
    size = F.least(F.col("item_size"), F.lit(WINDOW))
    allowed = F.when(size < WINDOW, F.lit(0)).otherwise(F.lit(EXCHANGED))
    first = F.greatest(item_at + SPAN - size, F.lit(0), item_at - at)
    last = F.least(item_at, F.col("item_size") - size, F.size(words) - size - at + item_at)
    # agreement word by word from the first window to the last
    same = F.transform(
        F.sequence("first", F.col("last") + size - 1),
        lambda j: (F.get(words, j + at - item_at) == F.get("near", j - context(item_at))).cast("int"),
    )
    in_window = F.transform(
        F.sequence(F.lit(1), F.col("last") - F.col("first") + 1),
        lambda s: F.aggregate(F.slice("same", s, size), F.lit(0), lambda total, x: total + x),
    )
    return (
        hits.withColumn("first", first)
        .withColumn("last", last)
        .where("first <= last")
        .withColumn("same", same)
        .withColumn("agreeing", F.array_max(in_window))
        .where(F.col("agreeing") >= size - allowed)
    )


def leaks(docs: DataFrame, benchmark: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id``, the first word of the document that a hit covers, and the most words in agreement.

    Hits are written to ``folder`` first. Then only documents whose id falls into a bucket
    with hits are cut into words again and meet them. The buckets are a fixed number, so
    they may be broadcast whatever the number of hits.
    """
    items = benchmark.select("item_id", word_hashes("text").alias("item_words"))
    items = items.where(F.size("item_words") >= SPAN)
    rows = items.agg(F.sum((F.size("item_words") - SPAN + 1) * len(MASKS))).first()[0] or 0
    blocks = max(1, math.ceil(rows / block))
    texts = docs.select("doc_id", word_hashes("text").alias("words"))

    def of_block(k: int) -> DataFrame:
        some = items.where(F.pmod(F.xxhash64("item_words"), F.lit(blocks)) == k)
        return seeds(texts, F.col("words"), "doc_id").join(F.broadcast(item_seeds(some)), "seed").drop("seed")

    hits = staged(reduce(DataFrame.unionByName, [of_block(k) for k in range(blocks)]), folder, "hits")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket")
    marked = F.broadcast(hits.select(bucket).distinct())  # of at most BUCKETS rows
    suspects = docs.select("doc_id", "text", bucket).join(marked, "bucket", "left_semi")
    texts = suspects.select("doc_id", word_hashes("text").alias("words"))
    hits = hits.withColumnRenamed("doc_id", "hit_id")
    met = texts.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")))
    return verified(met).groupBy("doc_id", "item_id").agg(F.min("at").alias("at"), F.max("agreeing").alias("agreeing"))


def clean_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without a leak; those without an id stay."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
