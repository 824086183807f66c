"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillcast.functions.text import as_col

_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)"


def url_hash(c: Column | str) -> Column:
    """Key of an article: SHA-256 of its URL as it stands, in hex."""
    return F.sha2(as_col(c), 256)


def url_scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(as_col(c), _ORIGIN, 1))


def url_host(c: Column | str) -> Column:
    return F.regexp_extract(as_col(c), _ORIGIN, 2)


def url_origin(c: Column | str) -> Column:
    return F.regexp_extract(as_col(c), _ORIGIN, 0)


def has_scheme_host(c: Column | str) -> Column:
    """True for an absolute URL of any scheme; the test for crawled links."""
    return F.coalesce(as_col(c).rlike(_ORIGIN), F.lit(False))


def is_web_url(c: Column | str) -> Column:
    """True for an absolute http or https URL; the test for registered sources."""
    host = url_host(c)
    paired = F.contains(host, F.lit("[")) == F.contains(host, F.lit("]"))
    return has_scheme_host(c) & url_scheme(c).isin("http", "https") & paired


def resolve_url(href: Column | str, base: Column | str) -> Column:
    """Absolute form of a link found on the page ``base``."""
    href, base = as_col(href), as_col(base)
    page = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/(?:.*/)?", 0)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(url_scheme(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(url_origin(base), href))
        .when(F.startswith(href, F.lit("?")), F.concat(page, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_extract(base, r"^[^#]*", 0), href))
        .when(folder != "", F.concat(folder, href))
        .otherwise(F.concat(url_origin(base), F.lit("/"), href))
    )
