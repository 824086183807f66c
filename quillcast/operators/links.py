"""Links and repository paths out of page bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcast import fixed
from quillcast.functions.text import plain_text, trim_blank
from quillcast.functions.urls import has_scheme_host, resolve_url, url_hash
from quillcast.operators.caps import crawl_cap, first_link

# Patterns that decide what counts as a link or a repository path.
MARKDOWN_LINK = r"\[([^\]]+)\]\((https?://[^)]+)\)"
REPO_IN_ARTICLE = r'(?s)<article[^>]*>.*?href="/([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+)".*?</article>'
REPO_BEFORE_SPAN = (
    r'href="/([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+)"[^>]*>\s*\n\s*<span[^>]*>[^<]*</span>'
)

# An anchor that is closed before the next one starts; the reference is quoted.
_ANCHOR = (
    r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*')[^>]*>"""
    r"((?:[^<]++|<(?!/?a[\s>]))*+)</a\s*>"
)


def _pairs(body: Column, pattern: str) -> Column:
    """Array of (first, second) for the two groups of every match."""
    firsts, seconds = (F.regexp_extract_all(body, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(firsts.alias("first"), seconds.alias("second"))


def markdown_links(pages: DataFrame, *keys: str, body: str = "body") -> DataFrame:
    """Web links ``[title](url)`` of a page, in page order."""
    return pages.select(
        *keys, F.posexplode(_pairs(F.col(body), MARKDOWN_LINK)).alias("pos", "link")
    ).select(*keys, "pos", F.col("link.first").alias("title"), F.col("link.second").alias("url"))


def top_links(
    pages: DataFrame, *keys: str, n: int = fixed.FEED_CAP, body: str = "body"
) -> DataFrame:
    """First ``n`` valid and distinct links of each page, found inside its row.

    A page never adds more than these to the first ``n`` of its source: if
    earlier pages hold ``d`` distinct links, at most ``d`` of them are repeats.
    """
    titles, urls = (F.regexp_extract_all(F.col(body), F.lit(MARKDOWN_LINK), F.lit(i)) for i in (1, 2))
    found = pages.select(
        *keys, titles.alias("_titles"), F.transform(urls, lambda u: trim_blank(u)).alias("_urls")
    )
    first = F.slice(F.array_distinct(F.filter("_urls", lambda u: has_scheme_host(u))), 1, n)
    links = F.transform(
        first,
        lambda u: F.struct(
            (F.array_position("_urls", u) - 1).cast("int").alias("pos"),
            F.element_at("_titles", F.array_position("_urls", u).cast("int")).alias("title"),
            u.alias("url"),
        ),
    )
    return found.select(*keys, F.inline(links))


def page_links(pages: DataFrame, *keys: str, body: str = "html", base: str = "url") -> DataFrame:
    """Anchors of an HTML page that have a text, with absolute URLs, in page order."""
    anchors = pages.select(
        *keys, F.col(base).alias("_base"), F.posexplode(_pairs(F.col(body), _ANCHOR)).alias("pos", "link")
    )
    text = plain_text("link.second")
    quoted = F.col("link.first")
    href = trim_blank(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    return anchors.select(
        *keys, "pos", text.alias("title"), resolve_url(href, "_base").alias("url")
    ).where("title <> ''")


def crawl_articles(links: DataFrame, n: int = fixed.FEED_CAP) -> DataFrame:
    """Links (source_id, page_id, pos, title, url) to articles.

    Invalid and repeated links are dropped before the cap, so a source gives
    ``n`` articles where it has that many. Their position is their place among
    the links kept.
    """
    valid = links.withColumn("url", trim_blank("url")).where(has_scheme_host("url"))
    return crawl_cap(first_link(valid), n, "place").select(
        "source_id",
        (F.col("place") - 1).cast("bigint").alias("position"),
        trim_blank("title").alias("title"),
        "url",
        F.lit("").alias("summary"),
        F.lit(None).cast("timestamp_ntz").alias("published_at"),
        url_hash("url").alias("url_hash"),
    )


def repo_paths(listing: DataFrame, page: str = "page_no", html: str = "html") -> DataFrame:
    """Distinct repository paths of each listing page, article matches first."""
    found = F.array_distinct(
        F.concat(
            *(
                F.regexp_extract_all(F.col(html), F.lit(p), F.lit(1))
                for p in (REPO_IN_ARTICLE, REPO_BEFORE_SPAN)
            )
        )
    )
    return listing.select(page, F.posexplode(found).alias("pos", "repo_path"))
