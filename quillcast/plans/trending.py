"""The trending report job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillcast import fixed
from quillcast.operators import trending as T
from quillcast.operators.links import repo_paths


def trending_top(
    listing: DataFrame,
    repos: DataFrame,
    keywords: list[str] = fixed.TREND_WORDS,
    k: int = fixed.REPORT_SIZE,
) -> DataFrame:
    """Best relevant repositories of the listing pages."""
    candidates = T.repo_candidates(repo_paths(listing))
    return T.top_repos(T.keyword_filter(T.repo_enrich(candidates, repos), keywords), k)


def trending_report(
    listing: DataFrame,
    repos: DataFrame,
    search: DataFrame,
    keywords: list[str] = fixed.TREND_WORDS,
    k: int = fixed.REPORT_SIZE,
) -> DataFrame:
    """The report as one message."""
    top = trending_top(listing, repos, keywords, k)
    return T.repo_report(T.rank_repos(T.top_repos_fallback(top, search, k)))
