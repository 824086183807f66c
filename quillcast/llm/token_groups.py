"""Near duplicates by exact Jaccard similarity of shingle sets, through a token-group matrix.

Equal sets are one class first. Classes fall into groups of similar sets: those with a pair
of smallest hashes in common are compared with one of them, the one with the fewest tokens of its own, and what is similar
enough is a group. What is left are links between groups. The matrix holds for each group the union of
its members' tokens, as far as they matter: with tokens in a fixed order, rare ones first,
two sets over the threshold share ``SHARED`` tokens of their first few. For each group and
token it keeps how many tokens a member has from there on, and the range of sizes, so the
overlap of a set with a whole group is bounded by the count of tokens that can count. Of
two groups the smaller one's sets ask the larger one. Only groups that reach the bound are
opened, by the tokens that count for them, and only their members that reach it too are
compared. Each set also has ``PARITIES`` bits: whether the number of its tokens with a certain
hash is odd. Where two sets differ in a bit they differ in a token, so pairs that differ in more
bits than similar sets can in tokens are left out before their sets are made; of a group,
bits in which all members agree are told apart from a set's. Sets of very many tokens may
differ in more than there are bits, and are compared as if they had none.
Sets of one group are never compared again, and members of a group meet a set
only through tokens that leave enough overlap, which a copy's own words don't.

The order of tokens comes from counts of words and of frequent tokens over all documents. Any
order is right; this one makes a shared token telling. Tokens of passages that stand in many
texts come last, so these texts don't all meet by them, however rare the words. Words and
tokens below a fixed share of all are equally rare, so the tables of counts are bounded
whatever the corpus.

Nulls, empty texts and texts of blanks have the empty set, are linked with nothing and are
their own component. Repeated rows are equal sets and get a row each. Null ids are sets
like others; a component's id is the smallest that is not null. Texts are taken whole.
An empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast.llm import shingle_sets
from quillcast.llm.common import few_rows, forget, staged
from quillcast.llm.components import components

BANDS = 4
SHARED = 3
COUNTED = 1 << 22  # words of a larger share than 1 / COUNTED are counted, so no more than that
OFTEN = 1 << 21  # the same of tokens
TOGETHER = 1_000_000  # words that are counted at once, and their tokens
LAST = np.uint16(1024)  # more than a token's words can have together, so frequent tokens come last
PARITIES = 512  # a power of two, and whole 64-bit numbers
FEW = 1_000_000  # rows of an id and a digest that may be broadcast, some 50 MB
SEEDS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1 for i in range(2 * BANDS)], np.uint64)


def shared_by(ratio: Fraction) -> int:
    """Tokens looked for in two beginnings: no more than any two similar sets that differ must share."""
    return min(SHARED, -(-ratio.numerator // (ratio.denominator - ratio.numerator)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each hash of tokens whether their number is odd, as bits of 64-bit numbers."""
    of = (tokens >> np.uint64(65 - PARITIES.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(of, minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64)


def common(spark: SparkSession, docs: DataFrame, folder: str, k: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Hashes of frequent words in order, with the binary logarithm of their counts, and the same of tokens."""

    def rows(hashes: np.ndarray, is_word: bool) -> pa.RecordBatch:
        found, counts = np.unique(hashes, return_counts=True)
        often = counts > 1  # the sum is a little low for those seen once here and there
        hashes, n = np.r_[signed(found[often]), 0], np.r_[counts[often], counts[~often].sum()]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), is_word)), pa.array(hashes), pa.array(n)], ["is_word", "hash", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tokens, size = [], [], 0
        for batch in batches:
            for some in shingle_sets.parts(t.as_py() for t in batch.column(0)):
                hashes, bounds = shingle_sets.word_hashes(some)
                words.append(hashes)
                tokens.extend(found for found, _ in shingle_sets.shingles(hashes, bounds, k))
                size += len(hashes)
                if size >= TOGETHER:
                    yield rows(np.concatenate(words), True)
                    yield rows(np.concatenate(tokens), False)
                    words, tokens, size = [], [], 0
        if words:
            yield rows(np.concatenate(words), True)
            yield rows(np.concatenate(tokens), False)

    counts = docs.select("text").where("text IS NOT NULL").mapInArrow(counted, "is_word boolean, hash bigint, n bigint")
    counts = staged(counts.groupBy("is_word", "hash").agg(F.sum("n").alias("n")), folder, "counts")
    totals = {row[0]: row[1] for row in counts.groupBy("is_word").agg(F.sum("n")).collect()}
    tables = []
    for is_word, least in (True, max(totals.get(True, 0) // COUNTED, 2)), (False, max(totals.get(False, 0) // OFTEN, 16)):
        of = F.col("is_word") if is_word else ~F.col("is_word")
        found = counts.where(of & (F.col("n") >= least) & (F.col("hash") != 0)).select("hash", "n").toArrow()
        hashes = found.column("hash").to_numpy().view(np.uint64)
        levels = np.log2(found.column("n").to_numpy().astype(float)).astype(np.uint16) + 1
        order = np.argsort(hashes)
        tables.append((hashes[order], levels[order]))
    forget(spark, folder, "counts")
    return tuple(tables)


def levels_of(hashes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The levels that a table has for hashes, 0 for others."""
    known, levels = table
    if not len(known):
        return np.zeros(len(hashes), np.uint16)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, levels[at], 0).astype(np.uint16)


def signatures(docs: DataFrame, k: int, ratio: Fraction, tables: tuple[tuple[np.ndarray, np.ndarray], ...]) -> DataFrame:
    """Per row: size and digest of the set, band keys, parities, and the tokens of its beginning in order.

    A set that is too small to be similar to any but an equal one has no keys, parities or tokens.
    """
    words, frequent = tables

    def signed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            sizes, digests, keys, bits, firsts = [], [], [], [], []
            for some in shingle_sets.parts(batch.column(1).to_pylist()):
                hashes, bounds = shingle_sets.word_hashes(some)
                level = levels_of(hashes, words)
                together = level[: max(len(level) - k + 1, 0)].copy()
                for i in range(1, k):
                    together += level[i : i + len(together)]
                for found, start in shingle_sets.shingles(hashes, bounds, k):
                    tokens, place = np.unique(found, return_index=True)
                    n = len(tokens)
                    sizes.append(n)
                    digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if n else None)
                    if n * (1 - ratio) < ratio:
                        keys.append(None)
                        bits.append(None)
                        firsts.append(None)
                        continue
                    least = np.minimum.reduce(tokens[:, None] * SEEDS ^ (tokens >> np.uint64(32))[:, None])
                    keys.append(signed(shingle_sets.mixed(least[::2] ^ shingle_sets.mixed(least[1::2]))))
                    bits.append(parities(tokens))
                    order = np.argsort(together[start + place] + levels_of(tokens, frequent) * LAST, kind="stable")
                    firsts.append(signed(tokens[order[: n - -(-n * ratio.numerator // ratio.denominator) + shared_by(ratio)]]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(bits, pa.list_(pa.int64())),
                    pa.array(firsts, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "node", "keys", "bits", "tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = f"doc_id {kind}, n bigint, node binary, keys array<bigint>, bits array<bigint>, tokens array<bigint>"
    return rows.mapInArrow(signed_sets, schema)


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Nodes with their sets and partners, of the documents that stand for ``wanted``.

    ``wanted`` (``doc_id, node, partners``) is broadcast where it is counted to be small; else
    the texts are shuffled.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            found = [s.tobytes() for s in shingle_sets.sets(batch.column(0).to_pylist(), k)]
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in found]
            same = [d == w for d, w in zip(digests, batch.column(1).to_pylist())]
            columns = [batch.column(1), pa.array(found, pa.binary()), batch.column(2)]
            out = pa.RecordBatch.from_arrays(columns, ["node", "tokens", "partners"])
            yield out.filter(pa.array(same, pa.bool_()))

    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    few = wanted.count() <= FEW
    rows = texts.join(F.broadcast(wanted) if few else wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]))
    schema = "node binary, tokens binary, partners array<binary>"
    return rows.select("text", "node", "partners").mapInArrow(made, schema)


def similar(sets: DataFrame, ratio: Fraction) -> DataFrame:
    """The pairs (``a, b``) of sets and their partners that are as similar as ``ratio``.

    Only partners' sets and one copy of the others for each partner are shuffled.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(ratio.denominator * shared >= ratio.numerator * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ends = sets.select(F.explode("partners").alias("node")).distinct()
    of_b = sets.select("node", "tokens").join(ends, "node", "left_semi").dropDuplicates(["node"])
    rows = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"), F.explode("partners").alias("b"))
    rows = rows.join(of_b.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(compared, "a binary, b binary")


def across(member: DataFrame, group: DataFrame, asks: Column, ratio: Fraction, on: str | list[str] = "token") -> DataFrame:
    """Sets and groups that they ask, or sets and members of groups, joined by tokens that can count.

    The first ``SHARED`` tokens that a similar pair shares leave each side at least as many
    tokens as the pair must share less those before.
    """
    n, m = F.col("n"), F.greatest(F.col("low"), -F.floor(-F.col("n") * ratio.numerator / ratio.denominator))
    # ceil(r / (1 + r) * (n + m)), in whole numbers
    must = -F.floor(-(n + m) * ratio.numerator / (ratio.numerator + ratio.denominator))
    return member.join(group, on).where(
        asks
        & (F.col("low") * ratio.numerator <= n * ratio.denominator)
        & (F.col("high") * ratio.denominator >= n * ratio.numerator)
        & (F.least("rest", "most") >= must - shared_by(ratio) + 1)
        & (F.least("common", "at_most") >= must)
    )


def close(ratio: Fraction) -> Column:
    """Whether a set of ``n`` tokens with ``bits`` may be similar to a member of a group.

    Members have at most ``high`` tokens, and all of them the bits ``every``, none others than ``some``.
    A similar pair of n and m tokens differs in at most (1 - r) / (1 + r) * (n + m).
    """
    bits, every, some = F.col("bits"), F.col("every"), F.col("some")
    apart = [
        F.bit_count(bits[i].bitwiseAND(F.bitwise_not(some[i])).bitwiseOR(every[i].bitwiseAND(F.bitwise_not(bits[i]))))
        for i in range(PARITIES // 64)
    ]
    m = F.least("high", F.floor(F.col("n") * ratio.denominator / ratio.numerator))
    of_all = (F.col("n") + m) * (ratio.denominator - ratio.numerator)
    return sum(apart[1:], apart[0]) * (ratio.denominator + ratio.numerator) <= of_all


def in_several(tokens: DataFrame, of: str) -> DataFrame:
    """The rows whose token stands in more than one ``of``."""
    several = tokens.groupBy("token").agg(F.min(of).alias("g"), F.max(of).alias("h")).where("g != h")
    return tokens.join(several.select("token"), "token", "left_semi")


def links(spark: SparkSession, docs: DataFrame, folder: str, k: int, ratio: Fraction) -> tuple[DataFrame, DataFrame]:
    """Rows with their classes (``doc_id, n, node``), and components of similar classes."""
    signed_rows = staged(signatures(docs, k, ratio, common(spark, docs, folder, k)), folder, "signatures")
    classes = signed_rows.where("keys IS NOT NULL").groupBy("node").agg(
        *(F.first(c).alias(c) for c in ("n", "keys", "bits", "tokens"))
    )
    classes = staged(classes, folder, "sets")
    signed_rows = staged(signed_rows.select("doc_id", "n", "node"), folder, "rows")
    forget(spark, folder, "signatures")
    # the beginning of each class's set, a row per token; hashes of nodes stand for them
    tokens = classes.select(F.xxhash64("node").alias("id"), F.col("n").cast("int").alias("n"), F.posexplode("tokens").alias("at", "token"))
    tokens = tokens.withColumn("rest", F.col("n") - F.col("at")).drop("at")
    # a class has a token once; keys of 40 bits are shuffled, and the few that are alike by chance only let more rows stay
    key = F.shiftright("token", 24)
    several = tokens.groupBy(key.alias("key")).agg(F.count("*").alias("held")).where("held > 1").select("key")
    tokens = staged(tokens.join(several, key == F.col("key"), "left_semi"), folder, "shared")
    met = tokens.groupBy("id").agg(F.count_distinct("token").alias("met"))
    classes = classes.withColumn("id", F.xxhash64("node")).join(met, "id", "left")
    looked_at = F.least(F.col("n"), F.col("n") + F.floor(-F.col("n") * ratio.numerator / ratio.denominator) + shared_by(ratio))
    classes = classes.withColumn("own", looked_at - F.coalesce("met", F.lit(0)))
    classes = staged(classes.select("id", "node", "n", "keys", "bits", "own"), folder, "classes")
    forget(spark, folder, "sets")

    # a group's centre has the fewest tokens that no other set has
    keys = classes.select("node", "own", F.posexplode("keys").alias("band", "key"))
    centre = F.min(F.struct("own", "node"))["node"].alias("b")
    centres = keys.groupBy("band", "key").agg(centre, F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = keys.join(centres, ["band", "key"]).where("node != b").select(F.col("node").alias("a"), "b").distinct()
    pairs = pairs.join(classes.select(F.col("node").alias("a"), "n", "bits"), "a")
    several = F.col("bits").alias("every"), F.col("bits").alias("some")
    pairs = pairs.join(classes.select(F.col("node").alias("b"), F.col("n").alias("high"), *several), "b")
    pairs = staged(pairs.where(close(ratio)).select("a", "b"), folder, "pairs")
    near = compared(docs, signed_rows, pairs, folder, "near", k, ratio)
    groups = components(near, folder, "groups")

    group = F.xxhash64(F.coalesce("component", "node")).alias("group")
    sizes = staged(groups.groupBy("component").agg(F.count("*").alias("size")), folder, "sizes")
    size = F.coalesce("size", F.lit(1)).alias("size")
    # no set has more in common with a class than the tokens that are not its own
    most = (F.col("n") - F.col("own")).alias("common")
    grouped = classes.join(groups.join(sizes, "component"), "node", "left").select("id", "n", group, size, most, "bits")
    grouped = staged(grouped, folder, "grouped")
    tokens = tokens.join(grouped.drop("n", "bits"), "id").withColumnRenamed("id", "node")
    tokens = staged(in_several(tokens, "group"), folder, "tokens")
    forget(spark, folder, "shared", "sizes")
    matrix = tokens.groupBy("token", F.col("group").alias("other")).agg(
        F.max("rest").alias("most"),
        F.max("common").alias("at_most"),
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        F.first("size").alias("other_size"),
        F.count("*").alias("held"),
    )
    # sets of the smaller group ask the larger one; a group opened keeps the tokens that count for it
    asks = (F.col("size") < F.col("other_size")) | ((F.col("size") == F.col("other_size")) & (F.col("group") < F.col("other")))
    opened = across(tokens, matrix, asks, ratio).groupBy("node", "other").agg(
        F.first("n").alias("n"),
        F.first("common").alias("common"),
        F.array_sort(F.collect_list(F.struct("held", "token", "rest"))).alias("by"),
    )
    bits = [F.col("bits")[i] for i in range(PARITIES // 64)]
    of_group = grouped.groupBy(F.col("group").alias("other")).agg(
        F.max("n").alias("high"),
        F.array(*map(F.bit_and, bits)).alias("every"),
        F.array(*map(F.bit_or, bits)).alias("some"),
    )
    opened = opened.where(F.size("by") >= shared_by(ratio)).join(grouped.select(F.col("id").alias("node"), "bits"), "node")
    opened = opened.join(of_group, "other").where(close(ratio)).drop("high", "every", "some")
    opened = staged(opened, folder, "opened")
    in_opened = tokens.join(opened.select(F.col("other").alias("group")).distinct(), "group", "left_semi")
    members = in_opened.join(grouped.select(F.col("id").alias("node"), *several), "node").select(
        F.col("node").alias("b"),
        "token",
        F.col("group").alias("other"),
        F.col("rest").alias("most"),
        F.col("common").alias("at_most"),
        F.col("n").alias("low"),
        F.col("n").alias("high"),
        "every",
        "some",
    )
    # of the tokens that a pair must share all but so many may be left out, so those of the most members are
    fewer = F.slice("by", F.lit(1), F.size("by") - (shared_by(ratio) - 1))
    askers = opened.select("node", "other", "n", "common", "bits", F.inline(fewer))
    met = across(askers, members, close(ratio), ratio, ["token", "other"])
    met = staged(met.select("other", F.col("node").alias("a"), "b").distinct(), folder, "met")
    asked = opened.select(F.col("node").alias("a"), "other", F.col("by.token").alias("by"))
    ends = met.select(F.col("b").alias("node")).distinct()
    held = tokens.join(ends, "node", "left_semi").groupBy(F.col("node").alias("b"))
    held = held.agg(F.collect_list("token").alias("held"))  # the first few of a set
    pairs = met.join(asked, ["a", "other"]).join(held, "b")
    pairs = pairs.where(F.size(F.array_intersect("by", "held")) >= shared_by(ratio)).select("a", "b")
    names = classes.select(F.col("node").alias("name"), "id")
    for end in ("a", "b"):
        pairs = pairs.join(names, F.col(end) == F.col("id")).withColumn(end, F.col("name")).drop("name", "id")
    far = compared(docs, signed_rows, staged(pairs, folder, "far-pairs"), folder, "far", k, ratio)
    forget(spark, folder, "tokens", "opened", "met", "grouped", "classes")
    found = components(staged(near.unionByName(far), folder, "all-links"), folder, "all")
    return signed_rows, found


def compared(docs: DataFrame, rows: DataFrame, pairs: DataFrame, folder: str, name: str, k: int, ratio: Fraction) -> DataFrame:
    """The pairs that are similar; sets are made anew for the documents of pairs alone."""
    ends = pairs.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("partners"))
    alone = pairs.select(F.col("b").alias("node")).distinct().join(ends, "node", "left_anti")
    ends = ends.unionByName(alone.withColumn("partners", F.expr("cast(array() AS array<binary>)")))
    ids = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = staged(ends.join(ids, "node"), folder, f"{name}-wanted")
    sets = staged(sets_of(docs, wanted, k), folder, f"{name}-sets")
    found = staged(similar(sets, ratio).distinct(), folder, name)
    forget(docs.sparkSession, folder, f"{name}-sets", f"{name}-wanted")
    return found


def near_duplicates(
    spark: SparkSession, docs: DataFrame, folder: str, k: int = 5, ratio: Fraction = Fraction(4, 5)
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    rows, found = links(spark, docs, folder, k, ratio)
    rows = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    smallest = staged(smallest, folder, "smallest")
    return rows.join(smallest, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str, k: int = 5, ratio: Fraction = Fraction(4, 5)) -> DataFrame:
    """The documents, all columns, of which each component keeps the row with the smallest id.

    Rows without an id stay if one of them is alone in its component. Repeated rows of the
    smallest id all stay.
    """
    found = near_duplicates(spark, docs, folder, k, ratio)
    is_first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = found.groupBy(F.col("doc_id").alias("_gone")).agg(F.max(is_first).alias("stays")).where("NOT stays").drop("stays")
    gone = staged(gone, folder, "gone")
    few = gone.count() <= FEW  # then no text is shuffled
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
