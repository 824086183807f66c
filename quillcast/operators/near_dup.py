"""Near-duplicates among the articles of a digest, however many it has.

Two articles are near-duplicates if the Jaccard similarity of their word
shingles reaches the threshold, which is above 0. Articles of equal shingles
are one set, so copies are never compared with each other. Two similar sets
share one of the rarest shingles of each (as many as a set may lack, and one),
so candidates come from an equi-join on those, less where too few shingles are
left behind the one that is met; similarity is then exact. No
cap is applied here. The digest job, which shows a capped number of articles, compares
these inside a row (``near_dup_keep_shown``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcast import fixed
from quillcast.functions.text import words
from quillcast.operators.connected import connected
from quillcast.sources import tables


def shingles(size: int) -> Column:
    """Distinct hashes of the ``size``-word shingles of the array ``_words``.

    A text of fewer words is one shingle.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - (size - 1), F.lit(1)))
    return F.array_distinct(
        F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("_words", i, size), " ")))
    )


def _in_sets(articles: DataFrame, size: int) -> DataFrame:
    """Articles with their shingles ``_set``, a key ``_key`` of digest and set, and ``_place``.

    Write them before a join on the key: Spark tests it for null before the join, and there
    cuts the text into words anew for each of its shingles.
    """
    digest = F.coalesce(F.col("digest_id").cast("string"), F.lit(""))
    return (
        articles.withColumn("_words", words(F.concat_ws(" ", "title", "summary")))
        .withColumn("_set", F.array_sort(shingles(size)))
        .withColumn("_key", F.sha2(F.concat_ws(" ", digest, F.array_join("_set", " ")), 256))
        .withColumn("_place", F.struct("source_id", "position"))
        .drop("_words")
    )


def _similar(sets: DataFrame, threshold: float) -> DataFrame:
    """``a``, ``b``, ``jaccard``: keys of similar sets of one digest, each pair once.

    ``sets`` has one row per set: ``digest_id``, ``_key``, ``_set``.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    each = sets.select("digest_id", "_key", F.size("_set").alias("_size"), F.explode("_set").alias("_shingle"))
    digest = F.coalesce(F.col("digest_id").cast("string"), F.lit(""))
    each = each.withColumn("_digest", digest).drop("digest_id")
    # A shingle of one set alone is no candidate, but has its place among the rarest.
    counts = each.groupBy("_digest", "_shingle").agg(F.count("*").alias("_n"))
    ranked = each.join(counts, ["_digest", "_shingle"]).groupBy("_digest", "_key", "_size")
    ranked = ranked.agg(F.array_sort(F.collect_list(F.struct("_n", "_shingle"))).alias("_ranked"))
    first = F.col("_size") - F.ceil(F.col("_size") * threshold - 1e-9).cast("int") + 1
    rare = ranked.select("_digest", "_key", "_size", F.posexplode(F.slice("_ranked", 1, first)).alias("_at", "_r"))
    rare = rare.where("_r._n > 1").withColumn("_rest", F.col("_size") - F.col("_at"))
    rare = rare.select("_digest", "_key", "_size", "_rest", F.col("_r._shingle").alias("_shingle"))
    side = lambda df, x: df.withColumnsRenamed({"_key": x, "_size": f"_size_{x}", "_rest": f"_rest_{x}"})
    least = F.least("_size_a", "_size_b") >= F.greatest("_size_a", "_size_b") * threshold - 1e-9
    # the first shingle that a similar pair shares leaves each side as many as the pair must share
    must = (F.col("_size_a") + F.col("_size_b")) * threshold / (1 + threshold) - 1e-6
    met = side(rare, "a").join(side(rare, "b"), ["_digest", "_shingle"])
    met = met.where((F.col("a") < F.col("b")) & least & (F.least("_rest_a", "_rest_b") >= must))
    met = met.select("a", "b").distinct()
    set_of = lambda x: sets.select(F.col("_key").alias(x), F.col("_set").alias(f"_set_{x}"))
    shared = F.size(F.array_intersect("_set_a", "_set_b"))
    jaccard = shared / (F.size("_set_a") + F.size("_set_b") - shared)
    both = met.join(set_of("a"), "a").join(set_of("b"), "b")
    return both.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)


def near_dup_sets(articles: DataFrame, size: int = 3, folder: str | None = None) -> DataFrame:
    """Each article with the first article of its digest that has the same shingles, which stands for it.

    ``digest_id, source_id, position, source_rep, position_rep``: a row per article, however many copies.
    Keys are written below ``folder``, so shingles are made once.
    """
    folder = folder or tables.scratch(articles.sparkSession)
    rows = _in_sets(articles, size).select("digest_id", "source_id", "position", "_key", "_place")
    rows = tables.staged(rows, f"{folder}/rows")
    first = rows.groupBy("_key").agg(F.min("_place").alias("_first"))
    return rows.join(first, "_key").select(
        "digest_id",
        "source_id",
        "position",
        F.col("_first.source_id").alias("source_rep"),
        F.col("_first.position").alias("position_rep"),
    )


def near_dup_pairs(articles: DataFrame, size: int = 3, threshold: float = 0.8, folder: str | None = None) -> DataFrame:
    """Similar articles of each digest of different shingles, each pair once, the earlier place first.

    Of copies only the first is in pairs; ``near_dup_sets`` gives the others. Sets are written
    below ``folder``, so shingles are made once.
    """
    folder = folder or tables.scratch(articles.sparkSession)
    sets = _in_sets(articles, size).groupBy("_key")
    sets = sets.agg(F.first("digest_id").alias("digest_id"), F.first("_set").alias("_set"), F.min("_place").alias("_place"))
    sets = tables.staged(sets, f"{folder}/sets")
    similar = _similar(sets.select("digest_id", "_key", "_set"), threshold)
    side = lambda x: sets.select("digest_id", F.col("_key").alias(x), F.col("_place").alias(f"_place_{x}"))
    both = similar.join(side("a"), "a").join(side("b").drop("digest_id"), "b")
    first, last = F.least("_place_a", "_place_b"), F.greatest("_place_a", "_place_b")
    return both.select("digest_id", first.alias("_f"), last.alias("_l"), "jaccard").select(
        "digest_id",
        F.col("_f.source_id").alias("source_a"),
        F.col("_f.position").alias("position_a"),
        F.col("_l.source_id").alias("source_b"),
        F.col("_l.position").alias("position_b"),
        "jaccard",
    )


def _rank() -> Column:
    """The longest summary first, of equals the earlier place; a null summary is shortest."""
    return F.struct((-F.coalesce(F.length("summary"), F.lit(-1))).alias("n"), "_place")


def near_dup_keep(articles: DataFrame, size: int = 3, threshold: float = 0.8, folder: str | None = None) -> DataFrame:
    """The most informative article of each connected group of near-duplicates of a digest.

    The longer summary is the more informative one; of equals, the earlier article. Groups
    are connected: if A is similar to B and B to C, one of the three stays. Links
    are between sets of equal shingles, so copies never make pairs. Rounds of the search
    for groups are written below ``folder``, by default in the shared folder.
    """
    spark = articles.sparkSession
    folder = folder or tables.scratch(spark)
    rows = tables.staged(_in_sets(articles, size).withColumn("_rank", _rank()), f"{folder}/rows")
    sets = rows.groupBy("_key").agg(
        F.first("digest_id").alias("digest_id"), F.first("_set").alias("_set"), F.min("_rank").alias("_best")
    )
    sets = tables.staged(sets, f"{folder}/sets")
    groups = connected(_similar(sets.select("digest_id", "_key", "_set"), threshold).select("a", "b"), folder)
    of_set = sets.join(groups, F.col("_key") == F.col("node"), "left")
    of_group = of_set.groupBy(F.coalesce("group", "_key").alias("_group"))
    best = of_group.agg(F.min(F.struct("_best", "_key")).alias("_b")).select("_b._key", F.col("_b._best").alias("_rank"))
    return rows.join(best, ["_key", "_rank"]).select(*articles.columns)


def near_dup_keep_shown(articles: DataFrame, size: int = 3, threshold: float = 0.8) -> DataFrame:
    """As ``near_dup_keep``, for articles under the digest cap: a digest is compared inside one row.

    Groups are closed by squaring: after k rounds an article knows all within 2**k links.
    """
    rows = _in_sets(articles, size).withColumn("_rank", _rank())
    one = F.struct("_place", "_rank", "_set", F.struct(*articles.columns).alias("row"))
    shown = rows.groupBy("digest_id").agg(F.array_sort(F.collect_list(one)).alias("_all"))
    places = F.sequence(F.lit(0), F.size("_all") - 1)

    def similar(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x["_set"], y["_set"]))
        return shared / (F.size(x["_set"]) + F.size(y["_set"]) - shared) >= threshold

    reach = F.transform("_all", lambda x: F.filter(places, lambda j: similar(x, F.get("_all", j))))
    shown = shown.withColumn("_reach", reach)
    for _ in range(_doublings(fixed.DIGEST_CAP)):
        further = lambda r: F.array_distinct(F.flatten(F.transform(r, lambda j: F.get("_reach", j))))
        shown = shown.withColumn("_reach", F.transform("_reach", further))
    best = lambda i: F.array_min(F.transform(F.get("_reach", i), lambda j: F.get("_all", j)["_rank"]))
    kept = F.filter("_all", lambda x, i: x["_rank"] == best(i))
    return shown.select(F.inline(F.transform(kept, lambda x: x["row"])))


def _doublings(n: int) -> int:
    """Rounds after which a chain of ``n`` is closed."""
    return max(n - 1, 1).bit_length()
