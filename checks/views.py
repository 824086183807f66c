"""Input tables for the queries, derived row by row from the test tables.

One text serves both engines; only hashing is spelled differently. No view ranks
rows or collects groups, so they grow with the tables like the real inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ENGINES = {
    "spark": {
        "id": "CAST(conv(substr(md5({0}), 1, 12), 16, 10) AS BIGINT)",
        "key": "sha2({0}, 256)",
    },
    "duckdb": {
        "id": "CAST(concat('0x', substr(md5({0}), 1, 12)) AS BIGINT)",
        "key": "sha256({0})",
    },
}

HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _texts(engine: str) -> dict[str, str]:
    def make_id(x: str) -> str:
        return ENGINES[engine]["id"].format(x)

    def make_key(x: str) -> str:
        return ENGINES[engine]["key"].format(x)

    source = make_id(HOST)
    return {
        "fx_sources": f"""
            SELECT source_id, source_id % 3 AS digest_id, host AS name,
                   concat('https://', host, '/feed') AS url,
                   CASE WHEN source_id % 13 = 0 THEN 'other'
                        WHEN source_id % 2 = 0 THEN 'crawl' ELSE 'rss' END AS type,
                   source_id % 5 <> 0 AS active
            FROM (SELECT DISTINCT {source} AS source_id, {HOST} AS host FROM pages) h""",
        "fx_entries": f"""
            SELECT {source} AS source_id, page_id * 2 + dup AS position, page_id,
                   CASE WHEN page_id % 17 = 0 THEN NULL ELSE concat(' ', url, ' ') END AS link,
                   CASE WHEN page_id % 19 = 0 THEN NULL ELSE {TITLE} END AS title,
                   CASE WHEN page_id % 3 = 0 THEN '' ELSE html END AS summary,
                   html AS description,
                   CASE WHEN page_id % 11 = 0 THEN 'junk' ELSE
                        concat('Mon, ', lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0'),
                               ' Jan 2024 08:', lpad(CAST(page_id % 60 AS STRING), 2, '0'),
                               ':00 GMT') END AS published
            FROM (SELECT page_id, url, html, 0 AS dup FROM pages
                  UNION ALL SELECT page_id, url, html, 1 AS dup FROM pages WHERE page_id % 10 = 0) e""",
        "fx_markdown": f"""
            SELECT {source} AS source_id, page_id, url,
                   concat('[', {TITLE}, '](', url, ') text [again](', url,
                          ') [rel](/x) [two](https://two.example/',
                          CAST(page_id % 9 AS STRING), ')') AS body
            FROM pages""",
        "fx_ledger": f"""
            SELECT p.url, {make_key('p.url')} AS url_hash, p.title, p.source_id, v.ts AS sent_at
            FROM (SELECT page_id, url, {TITLE} AS title, {source} AS source_id FROM pages
                  WHERE page_id % 3 = 0) p
            JOIN events v ON v.event_id = p.page_id""",
        "fx_page_marks": f"""
            SELECT {make_key('p.url')} AS url_hash, v.ts AS marked_at
            FROM (SELECT page_id, url FROM pages WHERE page_id % 4 = 1) p
            JOIN events v ON v.event_id = p.page_id * 40""",
        "fx_marks": f"""
            SELECT user_id AS tenant_id, marked_at, url_hash FROM (
                SELECT user_id, ts AS marked_at,
                       {make_key("concat('https://m.example/', CAST(event_id % 40 AS STRING))")} AS url_hash
                FROM events) m""",
        "fx_settings_log": """
            SELECT event_type AS key, props AS value, ts AS updated_at, event_id AS seq FROM events""",
        "fx_mutations": """
            SELECT s.source_id + CASE WHEN v.event_id % 9 = 0 THEN 1 ELSE 0 END AS source_id,
                   CASE WHEN v.event_type = 'signup' THEN 'enable' ELSE 'disable' END AS action,
                   v.ts, v.event_id AS seq
            FROM events v JOIN (SELECT page_id, {source} AS source_id FROM pages) s
              ON s.page_id = v.user_id
            WHERE v.event_type IN ('signup', 'error')""".replace("{source}", source),
        "fx_time_texts": """
            SELECT event_id, concat(CAST(event_id % 30 AS STRING),
                   CASE WHEN event_id % 7 = 0 THEN '.' ELSE ':' END,
                   lpad(CAST(event_id % 70 AS STRING), 2, '0')) AS time_text
            FROM events""",
        "fx_add_lines": """
            SELECT page_id AS seq, CASE
                   WHEN page_id % 5 = 0 THEN concat('ftp://host/', CAST(page_id AS STRING), ' Bad Scheme rss')
                   WHEN page_id % 5 = 1 THEN concat(url, ' rss')
                   WHEN page_id % 5 = 2 THEN concat(url, ' My Blog crawl')
                   WHEN page_id % 5 = 3 THEN concat('https://again.example/', CAST(page_id % 4 AS STRING), ' My  Long Blog Name')
                   ELSE 'nonsense' END AS line
            FROM pages""",
        "fx_repos": """
            SELECT doc_id, concat(source, '/Doc', CAST(doc_id AS STRING)) AS full_name,
                   text AS description, n_chars AS stargazers_count,
                   CASE WHEN lang = 'es' THEN NULL ELSE lang END AS language,
                   CASE WHEN doc_id % 4 = 0 THEN 'llm,ai-agents'
                        WHEN doc_id % 4 = 1 THEN 'LLM,data' ELSE 'web,infra' END AS topic_list,
                   concat('https://git.example/', source, '/Doc', CAST(doc_id AS STRING)) AS html_url
            FROM documents""",
        "fx_listing": """
            SELECT CAST(floor(doc_id / 25) AS BIGINT) AS page_no, doc_id % 25 AS pos,
                   concat('src', CAST(n % 20 AS STRING), '/DOC', CAST(n AS STRING)) AS repo_path
            FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id - doc_id % 60
                                      ELSE doc_id - doc_id % 3 END AS n FROM documents) d""",
        "fx_pubdates": """
            SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'junk' ELSE concat(
                   'Mon, ', lpad(CAST(day(ts) AS STRING), 2, '0'), ' Jan 2024 ',
                   lpad(CAST(hour(ts) AS STRING), 2, '0'), ':', lpad(CAST(minute(ts) AS STRING), 2, '0'),
                   ':', lpad(CAST(second(ts) AS STRING), 2, '0'), ' GMT') END AS pub_text
            FROM events""",
    }


SPARK, DUCKDB = _texts("spark"), _texts("duckdb")
TABLES = ("pages", "documents", "events")


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables in ``sf_dir``."""
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", SPARK[name])
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def with_views(body: str, *names: str) -> str:
    """A DuckDB query with the named views in front."""
    return with_steps(body, *((name, DUCKDB[name]) for name in names))


def with_steps(body: str, *steps: tuple[str, str]) -> str:
    """A DuckDB query with the named steps in front."""
    head = ",\n".join(f"{name} AS ({text})" for name, text in steps)
    return f"WITH RECURSIVE {head}\n{body}" if steps else body
