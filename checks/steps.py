"""SQL steps the expected results are put together from (DuckDB)."""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from checks.views import DUCKDB, with_steps
from quillcast import fixed

ASOF = datetime(2024, 1, 30, 23, 0)
MARK_TTL = "12 hours"
TENANT_TTL = "6 hours"
ZONE = "America/Toronto"

# Words that occur in the generated texts, so that all topics get articles.
TEST_TOPIC_WORDS = dict(
    zip(
        fixed.TOPICS,
        [["the", "of", "and"], ["le", "la", "des"], ["der", "sch", "aulich"], ["el", "los", "que"], ["x"]],
    )
)
SIZE, THRESHOLD = 3, 0.8

LOCAL_DAY = f"{ASOF.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(ZONE)):%A, %B %-d %Y}"
AT = f"TIMESTAMP '{ASOF:%Y-%m-%d %H:%M:%S}'"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def untag(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def escape(x: str) -> str:
    return rf"regexp_replace({x}, '([\\_\[\]()~`>#+=|{{}}.!-])', '\\\1', 'g')"


def escape_star(x: str) -> str:
    return rf"regexp_replace({x}, '([\\_*\[\]()~`>#+=|{{}}.!-])', '\\\1', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"


def summary(x: str) -> str:
    return f"substr({squeeze(trim(untag(trim(x))))}, 1, 500)"


def lit(text: str) -> str:
    """A text as SQL; line breaks are spelled out."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "concat(" + ", chr(10), ".join(parts) + ")"


def normal(entries: str) -> str:
    return f"""
        SELECT source_id, position, {trim("coalesce(title, 'No title')")} AS title, url,
               {summary('content')} AS summary,
               try_strptime(substr(published, 6), '%d %b %Y %H:%M:%S GMT') AS published_at,
               sha256(url) AS url_hash
        FROM (SELECT *, {trim("coalesce(link, '')")} AS url,
                     coalesce(nullif(summary, ''), nullif(description, ''), '') AS content
              FROM {entries}) WHERE url <> ''"""


ARTICLES = ("o_articles", normal("fx_entries"))

LIVE = (
    "o_live",
    f"""SELECT DISTINCT url_hash FROM fx_page_marks WHERE marked_at <= {AT} AND marked_at >= (
            SELECT CASE WHEN max(marked_at) + INTERVAL {MARK_TTL} > {AT} THEN
                        max(marked_at) FILTER (WHERE before IS NULL
                            OR marked_at >= before + INTERVAL {MARK_TTL}) END
            FROM (SELECT marked_at, lag(marked_at) OVER (ORDER BY marked_at) AS before
                  FROM (SELECT DISTINCT marked_at FROM fx_page_marks WHERE marked_at <= {AT})))""",
)

LINK = r"\[([^\]]+)\]\((https?://[^)]+)\)"


def links(pages: str, *keys: str) -> str:
    cols = ", ".join(keys)
    return f"""
        SELECT {cols}, generate_subscripts(regexp_extract_all(body, '{LINK}', 1), 1) - 1 AS pos,
               unnest(regexp_extract_all(body, '{LINK}', 1)) AS title,
               unnest(regexp_extract_all(body, '{LINK}', 2)) AS url
        FROM {pages}"""


def crawled(links: str) -> str:
    """Articles of a link table: valid, first of each URL, then the first ten per source."""
    return f"""
        SELECT source_id, n - 1 AS position, {trim('title')} AS title, url,
               '' AS summary, CAST(NULL AS TIMESTAMP) AS published_at, sha256(url) AS url_hash
        FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page_id, pos) AS n
              FROM (SELECT *, row_number() OVER (PARTITION BY source_id, url ORDER BY page_id, pos) AS k
                    FROM (SELECT source_id, page_id, pos, title, {trim('url')} AS url FROM {links})
                    WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]'))
              WHERE k = 1)
        WHERE n <= 10"""


FETCHED = [
    ("fx_sources", DUCKDB["fx_sources"]),
    ("fx_entries", DUCKDB["fx_entries"]),
    ("fx_markdown", DUCKDB["fx_markdown"]),
    (
        "o_feed_cap",
        """SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.source_id ORDER BY position) AS n
                          FROM fx_entries e JOIN fx_sources s USING (source_id)
                          WHERE s.active AND s.type = 'rss') WHERE n <= 10""",
    ),
    (
        "o_links",
        links(
            "(SELECT m.* FROM fx_markdown m JOIN fx_sources s USING (source_id) "
            "WHERE s.active AND s.type = 'crawl')",
            "source_id",
            "page_id",
        ),
    ),
    (
        "o_fetched",
        f"""SELECT a.*, s.name AS source_name, s.digest_id FROM
            ({normal('o_feed_cap')} UNION ALL {crawled('o_links')}) a
            JOIN fx_sources s USING (source_id)""",
    ),
]

NEW = FETCHED + [
    ("fx_page_marks", DUCKDB["fx_page_marks"]),
    ("fx_ledger", DUCKDB["fx_ledger"]),
    LIVE,
    (
        "o_new",
        """SELECT * FROM o_fetched WHERE url_hash NOT IN (SELECT url_hash FROM o_live)
           AND url_hash NOT IN (SELECT url_hash FROM fx_ledger)""",
    ),
]

CAPPED = NEW + [
    (
        "o_capped",
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY digest_id ORDER BY source_id, position) AS place
                          FROM o_new) WHERE place <= 30""",
    ),
]

# Articles of all entries with the digest of their source, without any cap.
ALL = [
    ("fx_sources", DUCKDB["fx_sources"]),
    ("fx_entries", DUCKDB["fx_entries"]),
    ARTICLES,
    (
        "o_all",
        """SELECT a.*, s.name AS source_name, s.digest_id FROM o_articles a JOIN fx_sources s USING (source_id)""",
    ),
]


def near_dups(articles: str) -> list[tuple[str, str]]:
    """Similar pairs, connected groups and what is kept of them, by comparing every pair."""
    return [
        (
            "o_sets",
            f"""SELECT digest_id, source_id, position, row(source_id, position) AS place, length(summary) AS size,
                    list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {SIZE - 1}, 1) + 1),
                        lambda i: array_to_string(w[i:i + {SIZE - 1}], ' ')))) AS sh
                FROM (SELECT *, {words("concat_ws(' ', title, summary)")} AS w FROM {articles})""",
        ),
        ("o_reps", "SELECT *, min(place) OVER (PARTITION BY digest_id, sh) AS rep FROM o_sets"),
        (
            "o_pairs",
            f"""SELECT *, shared / (len(sa) + len(sb) - shared) AS jaccard FROM (
                    SELECT a.digest_id, a.source_id AS source_a, a.position AS position_a,
                           b.source_id AS source_b, b.position AS position_b, a.place AS pa, b.place AS pb,
                           a.sh AS sa, b.sh AS sb, len(list_intersect(a.sh, b.sh)) AS shared
                    FROM o_reps a JOIN o_reps b ON a.digest_id = b.digest_id AND a.place < b.place
                    WHERE a.place = a.rep AND b.place = b.rep)
                WHERE shared / (len(sa) + len(sb) - shared) >= {THRESHOLD}""",
        ),
        (
            "o_reach",
            """SELECT digest_id, rep AS node, rep AS root FROM o_reps
               UNION SELECT r.digest_id, CASE WHEN r.node = p.pa THEN p.pb ELSE p.pa END, r.root
               FROM o_reach r JOIN o_pairs p ON p.digest_id = r.digest_id AND (r.node = p.pa OR r.node = p.pb)""",
        ),
        ("o_groups", "SELECT digest_id, node, min(root) AS grp FROM o_reach GROUP BY ALL"),
        (
            "o_kept",
            f"""SELECT c.* FROM {articles} c JOIN (
                    SELECT digest_id, source_id, position, row_number() OVER (
                        PARTITION BY digest_id, grp ORDER BY size DESC, place) AS n
                    FROM o_reps r JOIN o_groups g USING (digest_id) WHERE g.node = r.rep) k
                ON k.digest_id = c.digest_id AND k.source_id = c.source_id AND k.position = c.position WHERE n = 1""",
        ),
    ]


PAIRS = CAPPED + near_dups("o_capped")
ALL_PAIRS = ALL + near_dups("o_all")


def topics(articles: str) -> str:
    scores = ", ".join(
        f"len(list_filter(w, lambda x: list_contains({listed!r}, x)))"
        for listed in TEST_TOPIC_WORDS.values()
    )
    names = "[" + ", ".join(f"'{t}'" for t in TEST_TOPIC_WORDS) + "]"
    return f"""
        SELECT *, {names}[topic_no] AS topic FROM (
            SELECT *, CASE WHEN list_max(scores) > 0 THEN list_position(scores, list_max(scores))
                           ELSE {len(TEST_TOPIC_WORDS)} END AS topic_no
            FROM (SELECT *, [{scores}] AS scores
                  FROM (SELECT *, {words("concat_ws(' ', title, summary)")} AS w FROM {articles})))"""


HEAD = r"^[^.!?]*[.!?]+(\s+[^.!?]*[.!?]+)?"
BRIEF = f"""trim(concat(trim(coalesce(nullif(regexp_extract(summary, '{HEAD}', 0), ''), summary)),
                   ' (', source_name, ')'))"""

BODIES = [
    ("o_topics", topics("o_kept")),
    (
        "o_sections",
        f"""SELECT digest_id, topic_no, topic, string_agg(
                concat('*', {escape_star('title')}, '*', chr(10), {escape(BRIEF)}),
                concat(chr(10), chr(10)) ORDER BY source_id, position) AS text
            FROM o_topics GROUP BY ALL""",
    ),
    (
        "o_bodies",
        f"""SELECT digest_id, string_agg(
                concat('*', {escape('topic')}, '*', chr(10), chr(10), text),
                concat(chr(10), chr(10)) ORDER BY topic_no) AS body
            FROM o_sections GROUP BY digest_id""",
    ),
]

HEADERS = (
    "o_headers",
    f"""SELECT digest_id, n_articles, n_sources, concat(
            '📰 *Your Daily AI & Tech Digest*', chr(10), '_',
            '{LOCAL_DAY}, ', n_articles, ' articles from ',
            n_sources, ' sources_', chr(10), {lit(fixed.SEPARATOR)}, chr(10), chr(10)) AS header
        FROM (SELECT digest_id, count(*) AS n_articles FROM o_new GROUP BY digest_id)
        JOIN (SELECT digest_id, count(*) AS n_sources FROM fx_sources WHERE active GROUP BY digest_id)
        USING (digest_id)""",
)

TEXTS = (
    "o_texts",
    f"""SELECT digest_id, concat(header, body, chr(10), chr(10), {lit(fixed.SEPARATOR)}, chr(10),
               {lit(fixed.DIGEST_FOOTER)}) AS text
        FROM o_bodies JOIN o_headers USING (digest_id)""",
)

HEADLINES = (
    "o_headlines",
    f"""SELECT digest_id, concat({lit(fixed.HEADLINES_INTRO)}, chr(10), chr(10), string_agg(
               concat('• ', title, ' (', source_name, ')'), chr(10) ORDER BY source_id, position)) AS body
        FROM o_capped GROUP BY digest_id""",
)


def chunks(source: str, key: str, text: str, limit: int = 4096) -> tuple[str, str]:
    """Message chunks, one cut per level of recursion."""
    cut = f"""CASE WHEN length(t) <= {limit} THEN length(t)
                   WHEN contains(substr(t, 1, {limit}), chr(10))
                   THEN {limit} - strpos(reverse(substr(t, 1, {limit})), chr(10))
                   ELSE {limit} END"""
    step = f"""SELECT k, n, substr(t, 1, cut) AS chunk, ltrim(substr(t, cut + 1), chr(10)) AS rest
               FROM (SELECT *, {cut} AS cut FROM"""
    return (
        "o_chunks",
        f"""{step} (SELECT {key} AS k, 0 AS n, {text} AS t FROM {source}))
            UNION ALL
            {step} (SELECT k, n + 1 AS n, rest AS t FROM o_chunks WHERE rest <> ''))""",
    )


def sql(body: str, *steps: tuple[str, str] | str) -> str:
    """A query with views (given by name) and steps in front, each once."""
    named = {}
    for s in steps:
        name, text = (s, DUCKDB[s]) if isinstance(s, str) else s
        named.setdefault(name, text)
    return with_steps(body, *named.items())
