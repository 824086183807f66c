"""All queries by name, each with the SQL that gives the same result where there is one."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import steps as S
from checks.steps import ASOF, AT, MARK_TTL, SIZE, TENANT_TTL, THRESHOLD, ZONE, escape, escape_star, sql, trim
from checks.views import table, view
from quillcast import fixed, schemas
from quillcast.functions import text as X
from quillcast.functions import times as D
from quillcast.functions import urls as U
from quillcast.operators import articles as A
from quillcast.operators import caps as K
from quillcast.operators import compose as C
from quillcast.operators import links as L
from quillcast.operators import near_dup as N
from quillcast.operators import novelty as V
from quillcast.operators import registry as G
from quillcast.operators import reports as R
from quillcast.operators import seen_set as E
from quillcast.operators import topics as P
from quillcast.operators import trending as T
from quillcast.plans import digest as Q
from quillcast.plans import trending as QT
from quillcast.sources import feeds, pages, repos, tables
from quillcast.streaming import seen as SN
from quillcast.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Tables and views of one folder of test data."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        load = view if name.startswith("fx_") else table
        found = load(self.spark, self.sf_dir, name)
        setattr(self, name, found)  # asked for once
        return found

    def articles(self) -> DataFrame:
        """All articles of the entries, without any cap."""
        return A.normalise(self.fx_entries)

    def all_articles(self) -> DataFrame:
        """All of them with the digest of their source."""
        return A.stamp_source(self.articles(), self.fx_sources)

    def live(self) -> DataFrame:
        return E.seen_set_live(self.fx_page_marks, ASOF, MARK_TTL)

    def fetched(self) -> DataFrame:
        return Q.fetched_articles(self.fx_sources, self.fx_entries, self.fx_markdown)

    def new(self) -> DataFrame:
        return V.filter_new_articles(self.fetched(), self.live(), self.fx_ledger)

    def staged(self, df: DataFrame) -> DataFrame:
        """Rows a query uses more than once."""
        return tables.staged(df, _folder(self))

    def capped(self) -> DataFrame:
        return K.digest_cap(self.new())

    def repos(self) -> DataFrame:
        return self.fx_repos.withColumn("topics", F.split("topic_list", ",")).drop("topic_list")

    def paths(self) -> DataFrame:
        return L.repo_paths(self.listing())

    def listing(self) -> DataFrame:
        """Listing pages as HTML, with article blocks on even and spans on odd pages."""
        block = F.when(
            F.col("page_no") % 2 == 0,
            F.format_string(
                '<article class="r">\n<h2><a href="/%s">x</a></h2></article>', "repo_path"
            ),
        ).otherwise(
            F.format_string('<a href="/%s" class="l">\n <span class="n">x</span></a>', "repo_path")
        )
        rows = F.array_sort(F.collect_list(F.struct("pos", block.alias("html"))))
        html = F.array_join(F.transform(rows, lambda r: r["html"]), "\n")
        # A page lists 25 documents, so the lists are bounded.
        return self.fx_listing.groupBy("page_no").agg(html.alias("html"))


def query(oracle: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if oracle is not None:
            ORACLES[build.__name__] = oracle
        return build

    return register


def text_of(c: str):
    return F.col(c).cast("string").alias(c)


# Scans, sources, sinks


@query("SELECT page_id, url, length(html) AS n_chars FROM pages WHERE html <> ''")
def page_scan(t):
    body = pages.read_pages(t.spark, f"{t.sf_dir}/pages.parquet", "html")
    return body.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


FEED_TITLE = trim("regexp_extract(html, '<title>([^<]*)</title>', 1)")


@query(
    f"""SELECT page_id, 0 AS position, {FEED_TITLE} AS title,
               url, {S.summary('html')} AS summary, '2024-01-01 08:30:00' AS published_at FROM pages
        UNION ALL
        SELECT page_id, 2, 'No title', concat(url, '&n=2'), '', NULL FROM pages WHERE page_id % 7 <> 0"""
)
def feed_scan(t):
    """Feed documents made of the pages; every 7th is cut off in its last entry."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    full = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>t</title><item><title><![CDATA['),
        title,
        F.lit("]]></title><link> "), esc(F.col("url")), F.lit(" </link><description><![CDATA["),
        F.col("html"),
        F.lit("]]></description><pubDate>Mon, 01 Jan 2024 08:30:00 GMT</pubDate></item>"),
        F.lit("<item><title>no link</title></item><item><link>"), esc(F.col("url")),
        F.lit("&amp;n=2</link></item></channel></rss>"),
    )
    cut = F.when(F.col("page_id") % 7 == 0, F.substring(full, F.lit(1), F.length(full) - 30)).otherwise(full)
    entries = feeds.parse_feeds(t.pages.select("page_id", cut.alias("body")), "page_id")
    found = A.normalise(entries.withColumn("source_id", F.col("page_id")))
    return found.select(
        F.col("source_id").alias("page_id"), "position", "title", "url", "summary", text_of("published_at")
    )


@query(
    f"""SELECT page_id, 0 AS position, {FEED_TITLE} AS title, url,
               '2024-05-09 08:00:00' AS published_at FROM pages WHERE page_id % 4 <> 0"""
)
def atom_scan(t):
    """Atom documents; every 4th has no alternate link, so no article."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
    rel = F.when(F.col("page_id") % 4 == 0, "self").otherwise("alternate")
    body = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="'), rel,
        F.lit('" href="'), esc(F.col("url")), F.lit('"/><title type="html"><![CDATA['),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1),
        F.lit("]]></title><published>2024-05-09T08:00:00Z</published></entry></feed>"),
    )
    entries = feeds.parse_feeds(t.pages.select("page_id", body.alias("body")), "page_id")
    found = A.normalise(entries.withColumn("source_id", F.col("page_id")))
    return found.select(
        F.col("source_id").alias("page_id"), "position", "title", "url", text_of("published_at")
    )


@query(
    f"""SELECT {FEED_TITLE} AS title, url, {S.summary('html')} AS summary, '2024-01-01 08:30:00' AS published_at FROM pages
        UNION ALL SELECT 'x—y', concat(url, '&n=2'), '', NULL FROM pages"""
)
def feed_dump_scan(t):
    """A dump with two entries of every page, read in parts."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    text = F.concat(
        F.lit("<channel><item><title><![CDATA["), title, F.lit("]]></title><link> "), esc(F.col("url")),
        F.lit(" </link><description><![CDATA["), F.col("html"),
        F.lit("]]></description><pubDate>Mon, 01 Jan 2024 08:30:00 GMT</pubDate></item>\n<item><title>x&mdash;y</title><link>"),
        esc(F.col("url")), F.lit("&n=2</link></item></channel>"),
    )
    folder = _folder(t)
    t.pages.select(text.alias("value")).write.text(folder)
    found = A.normalise(feeds.read_feed_dump(t.spark, folder).withColumn("source_id", F.lit(1)))
    return found.select("title", "url", "summary", text_of("published_at"))


@query("SELECT page_id FROM pages WHERE page_id % 5 IN (0, 1)")
def feeds_without_entries(t):
    """Feed documents that give no entry: broken in the first one, or without any."""
    body = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("<rss><channel><item><title>"), F.length("html")))
        .when(F.col("page_id") % 5 == 1, F.lit("<rss><channel></channel></rss>"))
        .otherwise(F.lit("<rss><channel><item><link>x</link></item><item><title>cut"))
    )
    return feeds.feeds_without_entries(t.pages.select("page_id", body.alias("body")), "page_id")


@query(sql("SELECT source_id, digest_id, name, url, type FROM fx_sources WHERE active", "fx_sources"))
def active_sources(t):
    return G.active_sources(t.fx_sources)


@query(
    sql(
        f"""SELECT source_id, {escape("concat(CASE WHEN active THEN '✅' ELSE '❌' END, ' #', source_id, ' ', name, ' [', type, ']')")} AS line
            FROM fx_sources""",
        "fx_sources",
    )
)
def list_sources(t):
    return G.registry_lines(G.all_sources(t.fx_sources))


@query(
    sql(
        "SELECT 'filled' AS registry, source_id, name, url, type, active FROM fx_sources UNION ALL "
        "SELECT 'empty', * FROM (VALUES "
        + ", ".join(f"({i}, '{n}', '{u}', '{k}', true)" for i, (n, u, k) in enumerate(fixed.DEFAULT_SOURCES, 1))
        + ") d",
        "fx_sources",
    )
)
def seed_if_empty(t):
    """A registry with sources stays as it is, one without gets the defaults."""
    registry = t.fx_sources.select("source_id", "name", "url", "type", "active")
    defaults = G.default_sources(t.spark)
    cases = {"filled": registry, "empty": registry.where("source_id < 0")}
    parts = [
        G.seed_if_empty(df, defaults).select(F.lit(case).alias("registry"), "*") for case, df in cases.items()
    ]
    return parts[0].unionByName(parts[1])


@query(
    sql(
        f"""SELECT url_hash, title, source_id, {AT}::VARCHAR AS sent_at FROM (
                SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY source_id, position) AS n FROM o_articles)
            WHERE n = 1 AND url_hash NOT IN (SELECT url_hash FROM fx_ledger)""",
        "fx_entries", "fx_ledger", S.ARTICLES,
    )
)
def ledger_append(t):
    rows = V.ledger_append(t.articles(), t.fx_ledger, ASOF)
    return rows.select("url_hash", "title", "source_id", text_of("sent_at"))


@query(
    sql(
        """SELECT w.key, coalesce(s.value, w.fallback) AS value
           FROM (SELECT 'view' AS key, 'a' AS fallback UNION ALL SELECT 'digest_time', '08:00') w
           LEFT JOIN (SELECT key, value FROM (SELECT *, row_number() OVER (
                          PARTITION BY key ORDER BY updated_at DESC, seq DESC) AS n FROM fx_settings_log)
                      WHERE n = 1) s USING (key)""",
        "fx_settings_log",
    )
)
def settings_get(t):
    wanted = t.spark.createDataFrame(
        [("view", "a"), ("digest_time", fixed.DIGEST_TIME)], "key string, default string"
    )
    return G.get_settings(t.fx_settings_log, wanted)


@query(
    sql(
        """SELECT key, value FROM (SELECT *, row_number() OVER (
               PARTITION BY key ORDER BY updated_at DESC, seq DESC) AS n FROM fx_settings_log) WHERE n = 1
           UNION ALL SELECT 'digest_time', '07:15'""",
        "fx_settings_log",
    )
)
def settings_latest(t):
    log = G.upsert_setting(t.fx_settings_log, "digest_time", "07:15", ASOF, 1)
    return G.settings_latest(log)


@query(
    sql(
        """SELECT page_no, md5(string_agg(CASE WHEN page_no % 2 = 0
               THEN concat('<article class="r">', chr(10), '<h2><a href="/', repo_path, '">x</a></h2></article>')
               ELSE concat('<a href="/', repo_path, '" class="l">', chr(10), ' <span class="n">x</span></a>') END,
               chr(10) ORDER BY pos)) AS body FROM fx_listing WHERE page_no % 5 <> 0 GROUP BY page_no""",
        "fx_listing",
    )
)
def listing_scan(t):
    """Listing responses; every 5th failed."""
    status = F.when(F.col("page_no") % 5 == 0, 503).otherwise(200)
    found = pages.fetched_only(t.listing().withColumn("status", status))
    return found.select("page_no", F.md5("html").alias("body"))


REPO_COLUMNS = "full_name, description, stargazers_count, language, html_url, topic_list AS topics"


@query(sql(f"SELECT lower(full_name) AS path, {REPO_COLUMNS} FROM fx_repos WHERE doc_id % 7 <> 0", "fx_repos"))
def repo_scan(t):
    """Lookup responses of the repositories; every 7th failed."""
    body = F.to_json(F.struct("full_name", "description", "topics", "stargazers_count", "language", "html_url"))
    responses = t.repos().select(
        F.lower("full_name").alias("path"),
        F.when(F.col("doc_id") % 7 == 0, 404).otherwise(200).alias("status"),
        body.alias("body"),
    )
    return repos.parse_repos(responses).withColumn("topics", F.array_join("topics", ","))


@query(sql(f"SELECT {REPO_COLUMNS} FROM fx_repos", "fx_repos"))
def search_scan(t):
    """Search responses with 25 repositories each."""
    item = F.struct("full_name", "description", "topics", "stargazers_count", "language", "html_url")
    responses = (
        t.repos()
        .groupBy(F.floor(F.col("doc_id") / 25))
        .agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("body"))
    )
    return repos.parse_search(responses.select("body")).withColumn("topics", F.array_join("topics", ","))


# Projections, filters, predicates

ARTICLE_OUT = "source_id, position, title, url, summary, published_at::VARCHAR AS published_at, url_hash"


@query(sql(f"SELECT {ARTICLE_OUT} FROM o_articles", "fx_entries", S.ARTICLES))
def normalise_articles(t):
    return t.articles().withColumn("published_at", text_of("published_at"))


@query(sql("SELECT source_id, position FROM fx_entries WHERE link IS NOT NULL", "fx_entries"))
def drop_linkless(t):
    return t.articles().select("source_id", "position")


@query(
    sql(
        """SELECT source_id, type, CASE type WHEN 'rss' THEN 'feed' WHEN 'crawl' THEN 'page' ELSE 'skip' END AS route
           FROM fx_sources""",
        "fx_sources",
    )
)
def route_by_type(t):
    return A.route_by_type(t.fx_sources).select("source_id", "type", "route")


@query(sql("SELECT source_id, name, type FROM fx_sources WHERE type NOT IN ('rss', 'crawl')", "fx_sources"))
def unknown_types(t):
    return A.unknown_types(t.fx_sources).select("source_id", "name", "type")


@query(
    sql(
        """SELECT seq, line, regexp_matches(split_part(line, ' ', 1), '^https?://[^/?#]') AS is_valid
           FROM fx_add_lines""",
        "fx_add_lines",
    )
)
def valid_urls(t):
    first = F.split_part("line", F.lit(" "), F.lit(1))
    return t.fx_add_lines.select("seq", "line", U.is_web_url(first).alias("is_valid"))


KEYWORDS_SQL = " OR ".join(f"contains(txt, '{w}')" for w in fixed.TREND_WORDS)
REPO_TEXT_SQL = "lower(concat(description, full_name, replace(topic_list, ',', ' ')))"


@query(sql(f"SELECT doc_id FROM (SELECT doc_id, {REPO_TEXT_SQL} AS txt FROM fx_repos) WHERE {KEYWORDS_SQL}", "fx_repos"))
def keyword_filter(t):
    return T.keyword_filter(t.repos()).select("doc_id")


@query(
    sql(
        """SELECT doc_id, coalesce(nullif(language, ''), 'N/A') AS language,
                  coalesce(nullif(description, ''), 'No description') AS description FROM fx_repos""",
        "fx_repos",
    )
)
def null_defaults(t):
    return t.repos().select(
        "doc_id",
        X.or_default("language", fixed.NO_LANGUAGE).alias("language"),
        X.or_default("description", fixed.NO_DESCRIPTION).alias("description"),
    )


@query(
    sql(
        r"""SELECT event_id, time_text, CAST(split_part(time_text, ':', 1) AS INT) AS hour,
                   CAST(split_part(time_text, ':', 2) AS INT) AS minute FROM fx_time_texts
            WHERE regexp_matches(time_text, '^\d{1,2}:\d{2}$')
              AND TRY_CAST(split_part(time_text, ':', 1) AS INT) <= 23
              AND TRY_CAST(split_part(time_text, ':', 2) AS INT) <= 59""",
        "fx_time_texts",
    )
)
def valid_times(t):
    return G.valid_times(t.fx_time_texts).select(
        "event_id", "time_text", D.hour_of("time_text").alias("hour"), D.minute_of("time_text").alias("minute")
    )


REGISTRATIONS = (
    "o_registrations",
    r"""SELECT seq, CASE WHEN len(w) >= 2 THEN w[1] END AS url,
               CASE WHEN len(w) >= 2 THEN array_to_string(
                    CASE WHEN typed AND len(w) > 2 THEN w[2:len(w) - 1] ELSE w[2:len(w)] END, ' ') END AS name,
               CASE WHEN len(w) >= 2 THEN CASE WHEN typed THEN lower(w[len(w)]) ELSE 'rss' END END AS type
        FROM (SELECT *, lower(w[len(w)]) IN ('rss', 'crawl') AS typed
              FROM (SELECT seq, string_split_regex(line, '\s+') AS w FROM fx_add_lines))""",
)


@query(sql("SELECT * FROM o_registrations", "fx_add_lines", REGISTRATIONS))
def parse_registrations(t):
    return G.parse_registrations(t.fx_add_lines)


# Joins


@query(
    sql(
        "SELECT source_id, position, url_hash FROM o_articles WHERE url_hash NOT IN (SELECT url_hash FROM o_live)",
        "fx_entries", "fx_page_marks", S.ARTICLES, S.LIVE,
    )
)
def anti_seen_set(t):
    return V.anti_seen_set(t.articles(), t.live()).select("source_id", "position", "url_hash")


@query(
    sql(
        "SELECT source_id, position, url_hash FROM o_articles WHERE url_hash NOT IN (SELECT url_hash FROM fx_ledger)",
        "fx_entries", "fx_ledger", S.ARTICLES,
    )
)
def anti_ledger(t):
    return V.anti_ledger(t.articles(), t.fx_ledger).select("source_id", "position", "url_hash")


@query(ORACLES["anti_ledger"])
def anti_ledger_kept(t):
    """The same from a kept ledger: a folded base, which is not shuffled, and a part since."""
    ledger = tables.ledger_of(t.spark, _folder(t), buckets=16)
    rows = t.fx_ledger.withColumn("sent_date", F.to_date("sent_at"))
    rows = rows.select("url_hash", "title", "source_id", "sent_at", "sent_date")
    newer = F.col("sent_at") >= D.at(ASOF)
    ledger.append("older", rows.where(~newer))
    ledger.fold(1)
    ledger.append("newer", rows.where(newer))
    return V.anti_ledger(t.articles(), ledger.view()).select("source_id", "position", "url_hash")


@query(
    sql(
        """SELECT source_id, position, title, url_hash FROM o_articles
           WHERE url_hash NOT IN (SELECT url_hash FROM fx_ledger)
             AND url_hash NOT IN (SELECT url_hash FROM o_live)""",
        "fx_entries", "fx_ledger", "fx_page_marks", S.ARTICLES, S.LIVE,
    )
)
def filter_new_articles(t):
    new = V.filter_new_articles(t.articles(), t.live(), t.fx_ledger)
    return new.select("source_id", "position", "title", "url_hash")


@query(
    sql(
        "SELECT DISTINCT url_hash FROM o_articles WHERE url_hash IN (SELECT url_hash FROM fx_ledger)",
        "fx_entries", "fx_ledger", S.ARTICLES,
    )
)
def sent_hashes(t):
    return V.sent_hashes(t.articles(), t.fx_ledger)


CANDIDATES = (
    "o_candidates",
    """SELECT page_no, pos, repo_path FROM (
           SELECT *, row_number() OVER (PARTITION BY repo_path ORDER BY page_no, pos) AS k FROM (
               SELECT page_no, repo_path, row_number() OVER (PARTITION BY page_no ORDER BY p) - 1 AS pos
               FROM (SELECT page_no, repo_path, min(pos) AS p FROM fx_listing GROUP BY ALL))
           WHERE pos < 20) WHERE k = 1""",
)
ENRICHED = (
    "o_enriched",
    """SELECT c.page_no, c.pos, c.repo_path, r.* FROM o_candidates c
       JOIN fx_repos r ON lower(r.full_name) = lower(c.repo_path)""",
)
TOP = (
    "o_top",
    f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY stargazers_count DESC, page_no, pos) AS rank
                       FROM (SELECT *, {REPO_TEXT_SQL} AS txt FROM o_enriched) WHERE {KEYWORDS_SQL})
        WHERE rank <= 10""",
)


@query(sql("SELECT page_no, pos, repo_path, full_name, stargazers_count FROM o_enriched", "fx_listing", "fx_repos", CANDIDATES, ENRICHED))
def repo_enrich(t):
    found = T.repo_enrich(T.repo_candidates(t.paths()), t.repos())
    return found.select("page_no", "pos", "repo_path", "full_name", "stargazers_count")


@query(
    sql(
        """SELECT a.source_id, a.position, s.name AS source_name, s.digest_id
           FROM o_articles a JOIN fx_sources s USING (source_id)""",
        "fx_entries", "fx_sources", S.ARTICLES,
    )
)
def stamp_source(t):
    return A.stamp_source(t.articles(), t.fx_sources).select(
        "source_id", "position", "source_name", "digest_id"
    )


@query(sql("SELECT digest_id, source_a, position_a, source_b, position_b, jaccard FROM o_pairs", *S.ALL_PAIRS))
def near_dup_pairs(t):
    """Over all articles of all entries; of copies the first."""
    return N.near_dup_pairs(t.staged(t.all_articles()), SIZE, THRESHOLD)


@query(
    sql(
        """SELECT digest_id, source_id, position, struct_extract(rep, 1) AS source_rep, struct_extract(rep, 2) AS position_rep
           FROM o_reps""",
        *S.ALL_PAIRS,
    )
)
def near_dup_sets(t):
    return N.near_dup_sets(t.all_articles(), SIZE)


@query(sql("SELECT digest_id, source_id, position, title FROM o_kept", *S.ALL_PAIRS))
def near_dup_keep(t):
    """One article of each connected group of all articles of all entries."""
    return N.near_dup_keep(t.staged(t.all_articles()), SIZE, THRESHOLD, _folder(t)).select(
        "digest_id", "source_id", "position", "title"
    )


@query(sql("SELECT digest_id, source_id, position, title FROM o_kept", *S.PAIRS))
def near_dup_keep_shown(t):
    """The same for the articles that digests show."""
    return N.near_dup_keep_shown(t.capped(), SIZE, THRESHOLD).select("digest_id", "source_id", "position", "title")


@query(
    sql(
        f"""SELECT count(*) AS sent_today FROM fx_ledger
            WHERE sent_at >= TIMESTAMP '2024-01-01 05:00:00'""",
        "fx_ledger",
    )
)
def count_sent_today(t):
    return R.count_sent_today(t.fx_ledger, datetime(2024, 1, 1, 23, 0), ZONE)


@query(
    sql(
        """SELECT source_id, name, fetched FROM (
               SELECT s.source_id, s.name, count(f.url) AS fetched FROM fx_sources s
               LEFT JOIN o_fetched f USING (source_id) GROUP BY ALL)
           UNION ALL SELECT -1, 'total', count(*) FROM o_fetched""",
        *S.FETCHED,
    )
)
def source_counts(t):
    return R.source_counts(t.fetched(), t.fx_sources).na.fill(-1, ["source_id"])


@query(
    sql(
        """SELECT count(*) AS n_in,
                  count(*) FILTER (WHERE url_hash NOT IN (SELECT url_hash FROM o_live)) AS n_after_set,
                  count(*) FILTER (WHERE url_hash NOT IN (SELECT url_hash FROM o_live)
                                     AND url_hash NOT IN (SELECT url_hash FROM fx_ledger)) AS n_after_ledger
           FROM o_articles""",
        "fx_entries", "fx_ledger", "fx_page_marks", S.ARTICLES, S.LIVE,
    )
)
def dedup_funnel(t):
    return V.dedup_funnel(t.articles(), t.live(), t.fx_ledger)


@query(
    sql(
        """SELECT digest_id, CAST(to_json(list({'title': title, 'summary': summary, 'source': source_name, 'url': url}
               ORDER BY source_id, position)) AS VARCHAR) AS payload FROM o_capped GROUP BY digest_id""",
        *S.CAPPED,
    )
)
def prompt_payload(t):
    return C.prompt_payload(t.capped())


@query(
    sql(
        "SELECT source_id, position, topic_no, topic FROM o_all_topics",
        "fx_entries", S.ARTICLES, ("o_all_topics", S.topics("o_articles")),
    )
)
def topic_assign(t):
    return P.topic_assign(t.articles(), S.TEST_TOPIC_WORDS).select(
        "source_id", "position", "topic_no", "topic"
    )


@query(
    sql(
        "SELECT digest_id, topic_no, topic, count(*) AS n_articles FROM o_topics GROUP BY ALL",
        *S.PAIRS, S.BODIES[0],
    )
)
def topic_groups(t):
    kept = N.near_dup_keep_shown(t.capped(), SIZE, THRESHOLD)
    return P.topic_groups(P.topic_assign(kept, S.TEST_TOPIC_WORDS))


@query(sql("SELECT * FROM o_headers", *S.NEW, S.HEADERS))
def digest_header(t):
    return C.digest_header(t.new(), t.fx_sources, ASOF)


STATUS_SQL = """SELECT (SELECT count(*) FROM fx_sources WHERE active) AS active_sources,
                       (SELECT count(*) FROM fx_ledger WHERE sent_at >= TIMESTAMP '2024-01-01 00:00:00') AS sent_today"""


@query(sql(STATUS_SQL, "fx_sources", "fx_ledger"))
def status_report(t):
    return R.status_report(t.fx_sources, t.fx_ledger, datetime(2024, 1, 1, 23, 0))


@query(
    sql(
        f"""SELECT concat('*📊 Bot Status*', chr(10), chr(10), 'Active sources: ', active_sources, chr(10),
                          'Articles sent today: ', sent_today) AS message FROM ({STATUS_SQL})""",
        "fx_sources", "fx_ledger",
    )
)
def status_message(t):
    return R.status_text(status_report(t))


@query(sql("SELECT * FROM o_headlines", *S.CAPPED, S.HEADLINES))
def fallback_headlines(t):
    return C.fallback_headlines(t.capped())


@query(
    sql(
        f"""SELECT digest_id, concat('📰 *Your Daily AI & Tech Digest*', chr(10), '_',
                   '{S.LOCAL_DAY}', '_', chr(10), {S.lit(fixed.SEPARATOR)}, chr(10), chr(10),
                   {S.lit(fixed.LINKED_INTRO)}, chr(10), chr(10), string_agg(concat('• [', {escape('title')}, '](', url,
                   ') _\\(', {escape('source_name')}, '\\)_'), chr(10) ORDER BY source_id, position), chr(10), chr(10),
                   {S.lit(fixed.SEPARATOR)}, chr(10), {S.lit(fixed.PLAIN_FOOTER)}) AS text
            FROM o_capped GROUP BY digest_id""",
        *S.CAPPED,
    )
)
def linked_headlines(t):
    return C.linked_headlines(t.capped(), ASOF)


# Caps and ranks


@query(
    sql(
        """SELECT source_id, position FROM (
               SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY position) AS n FROM fx_entries)
           WHERE n <= 10 AND link IS NOT NULL""",
        "fx_entries",
    )
)
def feed_cap(t):
    return A.normalise(K.feed_cap(t.fx_entries)).select("source_id", "position")


@query(
    sql(
        """SELECT source_id, page_id, pos, url FROM (
               SELECT *, row_number() OVER (PARTITION BY source_id, url ORDER BY page_id, pos) AS n FROM o_all_links)
           WHERE n = 1""",
        "fx_markdown", ("o_all_links", S.links("fx_markdown", "source_id", "page_id")),
    )
)
def first_link(t):
    links = L.markdown_links(t.fx_markdown, "source_id", "page_id")
    return K.first_link(links).select("source_id", "page_id", "pos", "url")


ALL_LINKS = ("o_all_links", S.links("fx_markdown", "source_id", "page_id"))


@query(
    sql(
        """SELECT source_id, page_id, pos FROM (
               SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page_id, pos) AS n FROM o_all_links)
           WHERE n <= 10""",
        "fx_markdown", ALL_LINKS,
    )
)
def crawl_cap(t):
    links = L.markdown_links(t.fx_markdown, "source_id", "page_id")
    return K.crawl_cap(links).select("source_id", "page_id", "pos")


@query(sql("SELECT digest_id, source_id, position, title, url_hash FROM o_capped", *S.CAPPED))
def digest_cap(t):
    return t.capped().select("digest_id", "source_id", "position", "title", "url_hash")


@query(
    sql(
        """SELECT digest_id, source_id, position, title, url_hash FROM o_new n WHERE NOT EXISTS (
               SELECT 1 FROM o_capped c WHERE c.source_id = n.source_id AND c.position = n.position)""",
        *S.CAPPED,
    )
)
def digest_overflow(t):
    return K.digest_overflow(t.staged(t.new())).select("digest_id", "source_id", "position", "title", "url_hash")


@query(sql("SELECT * FROM o_candidates", "fx_listing", CANDIDATES))
def repo_candidates(t):
    return T.repo_candidates(t.paths()).select("page_no", "pos", "repo_path")


# Sorts, limits, top-k


@query(
    sql("SELECT full_name, stargazers_count, page_no, pos FROM o_top", "fx_listing", "fx_repos", CANDIDATES, ENRICHED, TOP)
)
def top_repos(t):
    return QT.trending_top(t.listing(), t.repos()).select(
        "full_name", "stargazers_count", "page_no", "pos"
    )


SEARCH_TOP = (
    "o_search_top",
    """SELECT *, row_number() OVER (ORDER BY stargazers_count DESC, full_name) AS rank FROM fx_repos
       WHERE list_contains(string_split(topic_list, ','), 'llm')
         AND list_contains(string_split(topic_list, ','), 'ai-agents')
       ORDER BY stargazers_count DESC, full_name LIMIT 10""",
)


@query(sql("SELECT full_name, stargazers_count FROM o_search_top", "fx_repos", SEARCH_TOP))
def top_repos_fallback(t):
    """No repository passes the keyword filter, so the search ranking is used."""
    none = QT.trending_top(t.listing(), t.repos(), ["no such word"])
    return T.top_repos_fallback(none, t.repos()).select("full_name", "stargazers_count")


# Set operations


@query(
    sql(
        """SELECT source_id, source_name, digest_id, position, title, url, summary,
                  published_at::VARCHAR AS published_at, url_hash FROM o_fetched""",
        *S.FETCHED,
    )
)
def union_sources(t):
    """Articles of feeds and crawled pages in one table."""
    return t.fetched().withColumn("published_at", text_of("published_at"))


# Scalar functions


@query(
    sql(
        "SELECT event_id, try_strptime(substr(pub_text, 6), '%d %b %Y %H:%M:%S GMT')::VARCHAR AS published_at FROM fx_pubdates",
        "fx_pubdates",
    )
)
def published_at(t):
    return t.fx_pubdates.select("event_id", D.published_at("pub_text").cast("string").alias("published_at"))


@query("SELECT page_id, sha256(url) AS url_hash FROM pages")
def url_hash(t):
    return t.pages.select("page_id", U.url_hash("url").alias("url_hash"))


@query(
    """SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
              regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages"""
)
def url_parts(t):
    return t.pages.select("page_id", U.url_scheme("url").alias("scheme"), U.url_host("url").alias("host"))


@query(f"SELECT doc_id, {escape('text')} AS escaped FROM documents")
def escape_text(t):
    return t.documents.select("doc_id", X.escape_markup("text").alias("escaped"))


@query(f"SELECT doc_id, {escape_star('text')} AS escaped FROM documents")
def escape_text_star(t):
    return t.documents.select("doc_id", X.escape_all_markup("text").alias("escaped"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN concat(substr(text, 1, 80), '...') ELSE text END AS short FROM documents")
def ellipsis(t):
    return t.documents.select("doc_id", X.ellipsis("text").alias("short"))


@query("SELECT doc_id, format('{:,}', n_chars * 1000) AS stars FROM documents")
def format_stars(t):
    return t.documents.select("doc_id", X.thousands(F.col("n_chars") * 1000).alias("stars"))


@query("SELECT event_id, strftime(ts, '%A, %B %-d %Y') AS day FROM events")
def long_date(t):
    return t.events.select("event_id", D.long_date("ts").alias("day"))


# Extraction


@query(sql(S.links("fx_markdown", "page_id"), "fx_markdown"))
def markdown_links(t):
    return L.markdown_links(t.fx_markdown, "page_id")


@query(
    sql(
        "SELECT source_id, position, title, url, url_hash FROM o_crawled",
        "fx_markdown", ALL_LINKS, ("o_crawled", S.crawled("o_all_links")),
    )
)
def crawl_articles(t):
    links = L.markdown_links(t.fx_markdown, "source_id", "page_id")
    return L.crawl_articles(links).select("source_id", "position", "title", "url", "url_hash")


@query(
    sql(
        """SELECT source_id, page_id, pos, title, url FROM (
               SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM (
                   SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS k FROM o_all_links)
               WHERE k = 1) WHERE n <= 2""",
        "fx_markdown", ALL_LINKS,
    )
)
def top_links(t):
    return L.top_links(t.fx_markdown, "source_id", "page_id", n=2)


ANCHOR_SQL = '<a href="([^"]*)">([^<]*)</a>'


def page_links_sql(*keys: str) -> str:
    return f"""
        SELECT {', '.join(keys)}, pos, title, concat(regexp_extract(url, '^https?://[^/?#]+', 0), href) AS url
        FROM (SELECT {', '.join(keys)}, url,
                     generate_subscripts(regexp_extract_all(html, '{ANCHOR_SQL}', 1), 1) - 1 AS pos,
                     unnest(regexp_extract_all(html, '{ANCHOR_SQL}', 1)) AS href,
                     {trim(f"unnest(regexp_extract_all(html, '{ANCHOR_SQL}', 2))")} AS title
              FROM fx_html) WHERE title <> ''"""


@query(sql(page_links_sql("page_id"), ("fx_html", "SELECT * FROM pages")))
def page_links(t):
    return L.page_links(t.pages, "page_id")


@query(
    sql(
        "SELECT source_id, position, title, url, url_hash FROM o_crawled",
        "fx_markdown",
        ("fx_html", "SELECT p.*, m.source_id FROM pages p JOIN fx_markdown m USING (page_id)"),
        ("o_html_links", page_links_sql("source_id", "page_id")),
        ("o_crawled", S.crawled("o_html_links")),
    )
)
def crawl_html(t):
    """Articles of the anchors of HTML pages."""
    sources = t.fx_markdown.select("page_id", "source_id")
    links = L.page_links(t.pages.join(sources, "page_id"), "source_id", "page_id")
    return L.crawl_articles(links).select("source_id", "position", "title", "url", "url_hash")


@query(
    sql(
        "SELECT page_no, row_number() OVER (PARTITION BY page_no ORDER BY p) - 1 AS pos, repo_path "
        "FROM (SELECT page_no, repo_path, min(pos) AS p FROM fx_listing GROUP BY ALL)",
        "fx_listing",
    )
)
def repo_paths(t):
    return t.paths()


@query(sql("SELECT k AS doc_id, n AS chunk_no, chunk FROM o_chunks", S.chunks("documents", "doc_id", "text")))
def split_messages(t):
    return C.split_messages(t.documents, "doc_id")


REPO_LINE = f"""concat(rank, '\\. [', {escape_star('full_name')}, '](', html_url, ')', chr(10), '⭐ ',
    format('{{:,}}', stargazers_count), ' \\| 💻 ', {escape_star("coalesce(language, 'N/A')")}, chr(10), '_',
    {escape_star("CASE WHEN length(description) > 80 THEN concat(substr(description, 1, 80), '...') ELSE description END")}, '_', chr(10))"""


def report_sql(source: str) -> str:
    return f"""SELECT concat({S.lit(fixed.TRENDING_TITLE)}, chr(10), chr(10),
                      string_agg({REPO_LINE}, chr(10) ORDER BY rank)) AS message FROM {source}"""


@query(sql(report_sql("o_search_top"), "fx_repos", SEARCH_TOP))
def repo_report(t):
    return T.repo_report(T.rank_repos(T.search_top(t.repos())))


@query(
    sql(
        f"SELECT source_id, position, {S.BRIEF} AS brief FROM (SELECT a.*, s.name AS source_name FROM o_articles a JOIN fx_sources s USING (source_id))",
        "fx_entries", "fx_sources", S.ARTICLES,
    )
)
def short_summary(t):
    stamped = A.stamp_source(t.articles(), t.fx_sources)
    return C.short_summary(stamped).select("source_id", "position", "brief")


@query(sql("SELECT digest_id, text FROM o_texts", *S.PAIRS, *S.BODIES, S.HEADERS, S.TEXTS))
def compose_digest(t):
    return Q.digest_texts(t.staged(t.new()), t.fx_sources, ASOF, topic_words=S.TEST_TOPIC_WORDS)


# Time and state


@query(
    f"""SELECT event_id, CAST(CAST(local - INTERVAL 8 HOUR - INTERVAL 1 MICROSECOND AS DATE) + 1 AS VARCHAR) AS digest_date
        FROM (SELECT event_id, ts - INTERVAL 5 HOUR AS local FROM events)"""
)
def digest_day(t):
    """The zone is five hours behind UTC in all of the events' month."""
    return t.events.select("event_id", D.digest_day("ts", "08:00", ZONE).cast("string").alias("digest_date"))


TENANT_LIVE = f"""
    SELECT m.tenant_id, m.url_hash FROM fx_marks m JOIN (
        SELECT tenant_id, max(marked_at) FILTER (WHERE before IS NULL OR marked_at >= before + INTERVAL {TENANT_TTL}) AS since,
               max(marked_at) AS last
        FROM (SELECT tenant_id, marked_at, lag(marked_at) OVER (PARTITION BY tenant_id ORDER BY marked_at) AS before
              FROM (SELECT DISTINCT tenant_id, marked_at FROM fx_marks WHERE marked_at <= {AT}))
        GROUP BY tenant_id) s USING (tenant_id)
    WHERE m.marked_at <= {AT} AND m.marked_at >= s.since AND s.last + INTERVAL {TENANT_TTL} > {AT}
    GROUP BY ALL"""


@query(sql(TENANT_LIVE, "fx_marks"))
def seen_set_live(t):
    return E.seen_set_live(t.fx_marks, ASOF, TENANT_TTL, ["tenant_id"])


@query(
    sql(
        f"""SELECT url_hash, CAST(min(marked_at) AS VARCHAR) AS arrived_at FROM fx_marks
            WHERE marked_at > {AT} AND url_hash NOT IN (
                SELECT url_hash FROM fx_marks WHERE marked_at <= {AT} AND marked_at + INTERVAL 1 HOUR > {AT})
            GROUP BY url_hash""",
        "fx_marks",
    )
)
def ttl_dedup(t):
    """Arrivals after a point in time against marks up to it, with a limit of an hour per key."""
    marks = t.fx_marks
    arrivals = marks.where(F.col("marked_at") > D.at(ASOF)).select(
        "url_hash", F.col("marked_at").alias("arrived_at")
    )
    kept = E.ttl_dedup(arrivals, marks, ASOF, "1 hour")
    return kept.select("url_hash", text_of("arrived_at"))


SENT_PER_DAY = "SELECT CAST(CAST({0} AS DATE) AS VARCHAR) AS sent_date, count(*) AS n_sent FROM {1} GROUP BY ALL"


@query(sql(SENT_PER_DAY.format("sent_at", "fx_ledger"), "fx_ledger"))
def sent_per_day(t):
    return R.sent_per_day(t.fx_ledger).withColumn("sent_date", text_of("sent_date"))


def _folder(t: Inputs) -> str:
    return tables.scratch(t.spark)


def _landed(t: Inputs, df: DataFrame, order: str, files: int = 3) -> DataFrame:
    """Stream of rows that landed in order of a column, in some files; a file is a batch."""
    path = _folder(t)
    ranged = t.staged(df.repartitionByRange(files, order).withColumn("_file", F.spark_partition_id()))
    for k in range(files):
        ranged.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return streams.landed(t.spark, path, df.schema, 1)


@query(SENT_PER_DAY.format("ts", "events"))
def stream_sent_per_day(t):
    """The running count over the events as a stream of sends; each batch writes the days it changes."""
    sent = _landed(t, t.events.select(F.col("ts").alias("sent_at")), "sent_at")
    root = _folder(t)
    streams.upsert_day_counts(streams.sent_per_day_stream(sent), root).awaitTermination()
    return streams.read_day_counts(t.spark, root).withColumn("sent_date", text_of("sent_date"))


@query(sql(TENANT_LIVE, "fx_marks"))
def stream_seen_set(t):
    """Live keys of all sets after several batches of marks up to a point in time."""
    marks = _landed(t, t.fx_marks.where(F.col("marked_at") <= D.at(ASOF)), "marked_at")
    kept = SN.SeenSet(t.spark, _folder(t), "tenant_id bigint", TENANT_TTL, buckets=16)
    SN.seen_stream(marks, kept).awaitTermination()
    return kept.live(ASOF)


@query(
    sql(
        f"""SELECT tenant_id, CAST(min(marked_at) AS VARCHAR) AS first_mark, CAST(max(marked_at) AS VARCHAR) AS last_mark,
                   count(*) AS n_marks
            FROM (SELECT *, sum(CASE WHEN before IS NULL OR marked_at >= before + INTERVAL {TENANT_TTL} THEN 1 ELSE 0 END)
                         OVER (PARTITION BY tenant_id ORDER BY marked_at RANGE UNBOUNDED PRECEDING) AS life
                  FROM (SELECT *, lag(marked_at) OVER (PARTITION BY tenant_id ORDER BY marked_at) AS before FROM fx_marks))
            GROUP BY tenant_id, life
            HAVING max(marked_at) + INTERVAL {TENANT_TTL} <= (SELECT max(marked_at) FROM fx_marks)""",
        "fx_marks",
    )
)
def stream_set_lives(t):
    """Every life of a set that has ended by the newest mark."""
    lives = SN.lives_stream(_landed(t, t.fx_marks, "marked_at"), TENANT_TTL, ["tenant_id"])
    out = streams.write_available(lives, _folder(t))
    return out.select("tenant_id", text_of("first_mark"), text_of("last_mark"), "n_marks")


@query("SELECT DISTINCT user_id AS key FROM events")
def stream_ttl_dedup(t):
    """Users let through by the stream over several batches, whose limit is longer than the events last."""
    arrivals = _landed(t, t.events.select(F.col("user_id").alias("key"), "ts"), "ts")
    deduped = streams.ttl_dedup_stream(arrivals, "key", "ts", "400 days")
    return streams.write_available(deduped, _folder(t)).select("key")


@query(
    sql(
        f"""SELECT source_id, position, title, url_hash FROM (
                SELECT a.source_id, a.position, a.title, a.url_hash FROM ({S.normal('o_cap')}) a
                JOIN fx_sources s USING (source_id) WHERE s.active AND s.type = 'rss')""",
        "fx_sources", "fx_entries",
        ("o_cap", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY position) AS n
                                    FROM fx_entries) WHERE n <= 10"""),
    )
)
def stream_digest(t):
    """New articles found by the stream over the entries; the ledger is empty before it."""
    found = t.spark.read.schema(schemas.ARTICLES).parquet(f"{_digest_stream(t)}/articles")
    return found.select("source_id", "position", "title", "url_hash")


def _digest_stream(t: Inputs) -> str:
    root = _folder(t)
    # Landed entries are what a stream starts from; each source has one document, in one file.
    t.fx_entries.drop("page_id").repartition("source_id").write.parquet(f"{root}/landed")
    entries = streams.landed(t.spark, f"{root}/landed", schemas.ENTRIES)
    words = S.TEST_TOPIC_WORDS
    streams.digest_stream(entries, t.fx_sources, f"{root}/run", ASOF, topic_words=words).awaitTermination()
    return f"{root}/run"


FEED_RUN = [
    ("fx_sources", S.DUCKDB["fx_sources"]),
    ("fx_entries", S.DUCKDB["fx_entries"]),
    (
        "o_cap",
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY position) AS n
                          FROM fx_entries) WHERE n <= 10""",
    ),
    (
        "o_new",
        f"""SELECT a.*, s.name AS source_name, s.digest_id FROM ({S.normal('o_cap')}) a
            JOIN fx_sources s USING (source_id) WHERE s.active AND s.type = 'rss'""",
    ),
    S.CAPPED[-1],
    *S.near_dups("o_capped"),
]


def _feed_files(t: Inputs, path: str) -> None:
    """One feed file for each source, in a folder with the hash of its URL."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    element = lambda name: F.when(F.col(name).isNotNull(), F.concat(F.lit(f"<{name}>"), esc(F.col(name)), F.lit(f"</{name}>")))
    fields = [F.coalesce(element(c), F.lit("")) for c in ("link", "title", "summary", "description")]
    item = F.concat(F.lit("<item>"), *fields, F.lit("<pubDate>"), F.col("published"), F.lit("</pubDate></item>"))
    owned = t.fx_entries.join(t.fx_sources.select("source_id", U.url_hash("url").alias("feed")), "source_id")
    # a feed shows its first entries, some more than the cap
    first = K.first_per_group(owned, ["source_id"], ["position"], 2 * fixed.FEED_CAP, "place")
    items = F.array_sort(F.collect_list(F.struct("place", item.alias("xml"))))
    body = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(items, lambda x: x["xml"]), ""), F.lit("</channel></rss>"))
    feeds_of = first.groupBy("feed").agg(body.alias("value"))
    feeds_of.repartition("feed").write.partitionBy("feed").option("lineSep", "\n\n").text(path)


@query(
    sql(
        """SELECT url_hash, title, source_id FROM (
               SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY source_id, position) AS n FROM o_new) WHERE n = 1""",
        *FEED_RUN,
    )
)
def stream_feed_files(t):
    """The ledger after a stream over landed feed files; the registry is read again for each batch."""
    path, root = _folder(t), _folder(t)
    _feed_files(t, path)
    entries = streams.landed_feeds(t.spark, path, first=fixed.FEED_CAP)
    registry = lambda session: view(session, t.sf_dir, "fx_sources")
    streams.digest_stream(entries, registry, root, ASOF, topic_words=S.TEST_TOPIC_WORDS).awaitTermination()
    return tables.ledger_of(t.spark, root).read().select("url_hash", "title", "source_id")


@query(
    sql(
        "SELECT k AS digest_id, n AS chunk_no, chunk FROM o_chunks",
        *FEED_RUN, *S.BODIES, S.HEADERS, S.TEXTS, S.chunks("o_texts", "digest_id", "text"),
    )
)
def stream_digest_messages(t):
    """Messages that the stream over the entries writes for its one batch."""
    root = _digest_stream(t)
    sent = t.spark.read.schema(schemas.MESSAGES).parquet(f"{root}/messages")
    return sent.select("digest_id", "chunk_no", "chunk")


# Registry


@query(
    sql(
        """SELECT (SELECT coalesce(max(source_id), 0) FROM fx_sources) + row_number() OVER (ORDER BY seq) AS source_id,
                  name, url, type, true AS active
           FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS n FROM o_registrations
                 WHERE regexp_matches(url, '^https?://[^/?#]'))
           WHERE n = 1 AND url NOT IN (SELECT url FROM fx_sources)""",
        "fx_sources", "fx_add_lines", REGISTRATIONS,
    )
)
def add_sources(t):
    return G.add_sources(t.fx_add_lines, t.fx_sources)


@query(
    sql(
        """SELECT seq, CASE WHEN url IS NULL THEN 'usage' WHEN NOT is_web THEN 'invalid'
                           WHEN place = 1 AND url NOT IN (SELECT url FROM fx_sources) THEN 'added'
                           ELSE 'duplicate' END AS outcome
           FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS place,
                        regexp_matches(url, '^https?://[^/?#]') AS is_web FROM o_registrations)""",
        "fx_sources", "fx_add_lines", REGISTRATIONS,
    )
)
def registration_results(t):
    return G.registration_results(t.fx_add_lines, t.fx_sources).select("seq", "outcome")


LAST_SWITCH = (
    "o_last",
    """SELECT source_id, action FROM (SELECT *, row_number() OVER (
           PARTITION BY source_id ORDER BY ts DESC, seq DESC) AS n FROM fx_mutations) WHERE n = 1""",
)


@query(
    sql(
        """SELECT s.source_id, s.name, coalesce(l.action = 'enable', s.active) AS active
           FROM fx_sources s LEFT JOIN o_last l USING (source_id)""",
        "fx_sources", "fx_mutations", LAST_SWITCH,
    )
)
def registry_state(t):
    return G.registry_state(t.fx_sources, t.fx_mutations).select("source_id", "name", "active")


@query(
    sql(
        "SELECT source_id, action, seq FROM fx_mutations WHERE source_id NOT IN (SELECT source_id FROM fx_sources)",
        "fx_sources", "fx_mutations",
    )
)
def unknown_mutations(t):
    return G.unknown_mutations(t.fx_sources, t.fx_mutations).select("source_id", "action", "seq")


@query(
    sql(
        """SELECT event_id AS seq, CAST(id_text AS BIGINT) AS source_id FROM (
               SELECT event_id, CASE WHEN event_id % 5 = 0 THEN concat(user_id, 'x') ELSE CAST(user_id AS VARCHAR) END AS id_text
               FROM events) WHERE regexp_matches(id_text, '^[0-9]+$')"""
    )
)
def switch_ids(t):
    """Switch commands whose id is a number."""
    user = F.col("user_id").cast("string")
    id_text = F.when(F.col("event_id") % 5 == 0, F.concat(user, F.lit("x"))).otherwise(user)
    lines = t.events.select(F.col("event_id").alias("seq"), id_text.alias("id_text"))
    return G.parse_switches(lines).select("seq", "source_id")


# Whole jobs


MESSAGES_SQL = sql(
    "SELECT k AS digest_id, n AS chunk_no, chunk FROM o_chunks",
    *S.PAIRS, *S.BODIES, S.HEADERS, S.TEXTS, S.chunks("o_texts", "digest_id", "text"),
)


@query(MESSAGES_SQL)
def digest_pipeline(t):
    """Messages of a run, from entries and pages to chunks."""
    return Q.digest_messages(compose_digest(t))


def _run_job(t: Inputs) -> str:
    """Run the job over a kept ledger and kept marks; gives the folder of its tables."""
    root = _folder(t)
    days = t.fx_ledger.withColumn("sent_date", F.to_date("sent_at"))
    before = days.select("url_hash", "title", "source_id", "sent_at", "sent_date")
    tables.ledger_of(t.spark, root).append("before", before)
    t.fx_page_marks.withColumn("run", F.lit("before")).write.partitionBy("run").parquet(f"{root}/marks")
    Q.run_digest(
        t.spark, t.fx_sources, t.fx_entries, t.fx_markdown, root, ASOF, MARK_TTL, S.TEST_TOPIC_WORDS
    )
    return root


@query(MESSAGES_SQL)
def digest_job(t):
    """The same messages from a run that writes and reads its tables."""
    sent = t.spark.read.schema(schemas.MESSAGES).parquet(f"{_run_job(t)}/messages")
    return sent.select("digest_id", "chunk_no", "chunk")


@query(
    sql(
        f"""SELECT url_hash, title, source_id, {AT}::VARCHAR AS sent_at FROM (
                SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY source_id, position) AS n FROM o_new)
            WHERE n = 1
            UNION ALL SELECT url_hash, title, source_id, sent_at::VARCHAR FROM fx_ledger""",
        *S.NEW,
    )
)
def digest_job_ledger(t):
    """The ledger after the run."""
    ledger = tables.ledger_of(t.spark, _run_job(t)).read()
    return ledger.select("url_hash", "title", "source_id", text_of("sent_at"))


@query(sql(report_sql("o_top"), "fx_listing", "fx_repos", CANDIDATES, ENRICHED, TOP))
def trending_pipeline(t):
    return QT.trending_report(t.listing(), t.repos(), t.repos())


@query(
    sql(
        """SELECT digest_id, CASE WHEN digest_id = 1 THEN body ELSE concat('Digest ', digest_id) END AS body,
                  digest_id = 1 AS is_fallback FROM o_headlines""",
        *S.CAPPED, S.HEADLINES,
    )
)
def digest_or_fallback(t):
    """Digest 1 has no text from elsewhere."""
    given = (
        t.fx_sources.where("digest_id <> 1")
        .select("digest_id", F.format_string("Digest %d", "digest_id").alias("body"))
        .distinct()
    )
    return C.digest_or_fallback(t.capped(), given)


@query(
    sql(
        f"""SELECT digest_id, n_sources, coalesce(n_fetched, 0) AS n_fetched, coalesce(n_new, 0) AS n_new,
                   CASE WHEN n_sources = 0 THEN 'no_sources' WHEN n_fetched IS NULL THEN 'nothing_fetched'
                        WHEN n_new IS NULL THEN 'nothing_new' ELSE 'sent' END AS outcome,
                   CASE WHEN n_sources > 0 AND n_fetched IS NULL THEN {escape(S.lit(fixed.NOTHING_FETCHED))}
                        WHEN n_fetched > 0 AND n_new IS NULL THEN {escape(S.lit(fixed.NOTHING_NEW))} END AS notice
            FROM (SELECT source_id % 30 AS digest_id, CAST(count_if(active) AS BIGINT) AS n_sources FROM fx_sources GROUP BY 1)
            LEFT JOIN (SELECT source_id % 30 AS digest_id, count(*) AS n_fetched FROM o_fetched GROUP BY 1) USING (digest_id)
            LEFT JOIN (SELECT source_id % 30 AS digest_id, count(*) AS n_new FROM o_new GROUP BY 1) USING (digest_id)""",
        *S.NEW,
    )
)
def run_outcome(t):
    """Outcome of each of thirty digests, so that some get nothing."""
    own = lambda df: df.withColumn("digest_id", F.col("source_id") % 30)
    fetched = t.staged(t.fetched())
    new = V.filter_new_articles(fetched, t.live(), t.fx_ledger)
    return Q.run_outcome(own(t.fx_sources), own(fetched), own(new))
