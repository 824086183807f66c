"""Schemas of the tables the jobs read and write."""

# One row per source; every source feeds one digest.
SOURCES = (
    "source_id bigint, digest_id bigint, name string, url string, type string, "
    "active boolean, added_at timestamp_ntz"
)
# Raw feed entries. ``position`` orders the entries of a source and is unique in it.
ENTRIES = (
    "source_id bigint, position bigint, link string, title string, summary string, "
    "description string, published string"
)
# Crawled pages. ``page_id`` orders the pages of a source.
PAGES = "source_id bigint, page_id bigint, url string, body string"
ARTICLES = (
    "source_id bigint, source_name string, digest_id bigint, position bigint, title string, "
    "url string, summary string, published_at timestamp_ntz, url_hash string"
)
LEDGER = (
    "url_hash string, title string, source_id bigint, sent_at timestamp_ntz, sent_date date"
)
MARKS = "url_hash string, marked_at timestamp_ntz"
SETTINGS_LOG = "key string, value string, updated_at timestamp_ntz, seq bigint"
MUTATIONS = "source_id bigint, action string, ts timestamp_ntz, seq bigint"
REPO = (
    "full_name string, description string, topics array<string>, stargazers_count bigint, "
    "language string, html_url string"
)
REPO_RESPONSE = "path string, status int, body string"
LISTING = "page_no bigint, status int, html string"
SEARCH = f"items array<struct<{REPO}>>"
MESSAGES = "digest_id bigint, chunk_no int, chunk string, digest_date date, run string"
