"""Ranking of repositories found on listing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillcast import fixed
from quillcast.functions.text import contains_any
from quillcast.operators.caps import first_per_group
from quillcast.operators.compose import repo_line


def repo_candidates(paths: DataFrame, n: int = fixed.LISTING_CAP) -> DataFrame:
    """First ``n`` paths of each page, and of these the first place of each path.

    A path that an earlier page had still uses up a place of its own page.
    """
    capped = first_per_group(paths, ["page_no"], ["pos"], n)
    return first_per_group(capped, ["repo_path"], ["page_no", "pos"], 1)


def repo_enrich(candidates: DataFrame, repos: DataFrame) -> DataFrame:
    """Metadata of the candidates; those without any are dropped.

    Repositories are found by the path that was asked for, which a renamed one no longer has
    as its name. Paths are compared in lower case, as a lookup ignores case. Of several
    responses for a path the latest counts (``landed_at``, if there is one), and of equal
    ones the one with the most stars.
    """
    asked = "path" if "path" in repos.columns else "full_name"
    latest = [F.desc("landed_at")] if "landed_at" in repos.columns else []
    found = repos.withColumn("_key", F.lower(asked)).drop("path")
    found = first_per_group(found, ["_key"], [*latest, F.desc("stargazers_count"), "full_name", "html_url"], 1)
    return candidates.withColumn("_key", F.lower("repo_path")).join(found, "_key").drop("_key")


def repo_text() -> Column:
    """Text searched for keywords: its parts follow each other without a gap."""
    topics = F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " ")
    return F.lower(
        F.concat(F.coalesce("description", F.lit("")), F.coalesce("full_name", F.lit("")), topics)
    )


def keyword_filter(repos: DataFrame, keywords: list[str] = fixed.TREND_WORDS) -> DataFrame:
    return repos.where(contains_any(repo_text(), keywords))


def top_repos(repos: DataFrame, k: int = fixed.REPORT_SIZE) -> DataFrame:
    """The ``k`` repositories with most stars, ties in the order found."""
    return repos.orderBy(F.desc("stargazers_count"), "page_no", "pos").limit(k)


def search_top(
    search: DataFrame, topics: list[str] = fixed.FALLBACK_TOPICS, k: int = fixed.REPORT_SIZE
) -> DataFrame:
    """The ``k`` repositories with most stars among those with all the topics."""
    found = search
    for topic in topics:
        found = found.where(F.array_contains("topics", topic))
    return found.orderBy(F.desc("stargazers_count"), "full_name").limit(k)


def top_repos_fallback(
    primary: DataFrame, search: DataFrame, k: int = fixed.REPORT_SIZE
) -> DataFrame:
    """The primary ranking, or the search ranking where that is empty.

    Both are at most ``k`` rows, so the choice is made over ``2 * k`` of them.
    """
    columns = ["full_name", "description", "topics", "stargazers_count", "language", "html_url"]
    found = search_top(search, k=k)
    for place in ("page_no", "pos"):
        found = found.withColumn(place, F.lit(0).cast(primary.schema[place].dataType))
        columns.append(place)
    both = (
        primary.select(*columns, F.lit(0).alias("_choice"))
        .unionByName(found.select(*columns, F.lit(1).alias("_choice")))
        .withColumn("_best", F.min("_choice").over(W.partitionBy()))
    )
    return both.where("_choice = _best").drop("_choice", "_best")


def rank_repos(top: DataFrame) -> DataFrame:
    """Number the repositories of a report from 1; at most a report's worth of rows."""
    order = [F.desc("stargazers_count")] + [c for c in ("page_no", "pos") if c in top.columns]
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order, "full_name")))


def repo_report(ranked: DataFrame) -> DataFrame:
    """One message: the title and an entry per repository, or that there is none."""
    rows = F.array_sort(F.collect_list(F.struct("rank", repo_line().alias("line"))))
    lines = F.transform(rows, lambda r: r["line"])
    whole = F.array_join(F.concat(F.array(F.lit(fixed.TRENDING_TITLE + "\n")), lines), "\n")
    message = F.when(F.count("*") > 0, whole).otherwise(F.lit(fixed.NO_REPOS))
    return ranked.agg(message.alias("message"))
