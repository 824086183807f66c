"""Digest texts and messages.

Everything here works on capped articles, at most a digest's worth per group,
so collecting the lines of a digest in order is bounded by the cap.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcast import fixed
from quillcast.functions.text import (
    ellipsis,
    escape_all_markup,
    escape_markup,
    leading_sentences,
    message_chunks,
    or_default,
)
from quillcast.functions.times import at, local_time, long_date

_ORDER = ["source_id", "position"]


def _join_lines(df: DataFrame, by: list[str], order: list[str], line: Column, sep: str) -> DataFrame:
    """One ``text`` per group: its lines in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    text = F.array_join(F.transform(rows, lambda r: r["line"]), sep)
    return df.groupBy(*by).agg(text.alias("text"))


def prompt_payload(capped: DataFrame) -> DataFrame:
    """The articles of each digest as a JSON array, in digest order."""
    item = F.struct(
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("source_name", F.lit("")).alias("source"),
        F.coalesce("url", F.lit("")).alias("url"),
    )
    rows = F.array_sort(F.collect_list(F.struct(*_ORDER, item.alias("item"))))
    payload = F.to_json(F.transform(rows, lambda r: r["item"]))
    return capped.groupBy("digest_id").agg(payload.alias("payload"))


def short_summary(articles: DataFrame) -> DataFrame:
    """Add ``brief``: the first one or two sentences, with the source in parentheses."""
    brief = F.concat(
        F.trim(leading_sentences("summary")), F.lit(" ("), F.coalesce("source_name", F.lit("")), F.lit(")")
    )
    return articles.withColumn("brief", F.trim(brief))


def digest_bodies(assigned: DataFrame) -> DataFrame:
    """Body of each digest: articles under their topic header, topics in fixed order."""
    briefs = short_summary(assigned)
    entry = F.concat(
        F.lit("*"), escape_all_markup("title"), F.lit("*\n"), escape_markup("brief")
    )
    topics = _join_lines(briefs, ["digest_id", "topic_no", "topic"], _ORDER, entry, "\n\n")
    section = F.concat(F.lit("*"), escape_markup("topic"), F.lit("*\n\n"), F.col("text"))
    return _join_lines(topics, ["digest_id"], ["topic_no"], section, "\n\n").select(
        "digest_id", F.col("text").alias("body")
    )


def fallback_headlines(capped: DataFrame) -> DataFrame:
    """Body used where no digest text is available: one headline per article."""
    line = F.concat(
        F.lit("• "),
        F.coalesce("title", F.lit(fixed.UNTITLED)),
        F.lit(" ("),
        F.coalesce("source_name", F.lit("")),
        F.lit(")"),
    )
    return _join_lines(capped, ["digest_id"], _ORDER, line, "\n").select(
        "digest_id", F.concat(F.lit(fixed.HEADLINES_INTRO + "\n\n"), "text").alias("body")
    )


def linked_line() -> Column:
    """Headline of an article as a link, with its source."""
    return F.concat(
        F.lit("• ["),
        escape_markup(F.coalesce("title", F.lit(fixed.UNTITLED))),
        F.lit("]("),
        F.coalesce("url", F.lit("")),
        F.lit(") _\\("),
        escape_markup(F.coalesce("source_name", F.lit(""))),
        F.lit("\\)_"),
    )


def linked_headlines(capped: DataFrame, asof: datetime, zone: str = fixed.DIGEST_ZONE) -> DataFrame:
    """Whole text of a digest of linked headlines, dated in ``zone``."""
    day = escape_markup(long_date(F.to_date(local_time(at(asof), zone))))
    lines = _join_lines(capped, ["digest_id"], _ORDER, linked_line(), "\n")
    return lines.select(
        "digest_id",
        F.concat(
            F.lit(f"{fixed.DIGEST_TITLE}\n_"),
            day,
            F.lit(f"_\n{fixed.SEPARATOR}\n\n{fixed.LINKED_INTRO}\n\n"),
            "text",
            F.lit(f"\n\n{fixed.SEPARATOR}\n{fixed.PLAIN_FOOTER}"),
        ).alias("text"),
    )


def digest_or_fallback(capped: DataFrame, bodies: DataFrame) -> DataFrame:
    """Body of each digest: the given one, else raw headlines."""
    given = bodies.select("digest_id", F.nullif("body", F.lit("")).alias("_given"))
    return (
        fallback_headlines(capped)
        .join(given, "digest_id", "left")
        .select("digest_id", F.coalesce("_given", "body").alias("body"), F.col("_given").isNull().alias("is_fallback"))
    )


def digest_header(
    new: DataFrame, sources: DataFrame, asof: datetime, zone: str = fixed.DIGEST_ZONE
) -> DataFrame:
    """Header of each digest: all its new articles, and the active sources asked for it.

    The date is the reader's: that of ``asof``, a UTC time, in ``zone``.
    """
    day = F.to_date(local_time(at(asof), zone))
    counts = new.groupBy("digest_id").agg(F.count("*").alias("n_articles"))
    asked = sources.where("active").groupBy("digest_id").agg(F.count("*").alias("n_sources"))
    figures = F.format_string(fixed.FIGURES, "n_articles", "n_sources")
    header = F.concat(
        F.lit(f"{fixed.DIGEST_TITLE}\n_"),
        escape_markup(long_date(day)),
        F.lit(", "),
        escape_markup(figures),
        F.lit(f"_\n{fixed.SEPARATOR}\n\n"),
    )
    return counts.join(asked, "digest_id").select(
        "digest_id", "n_articles", "n_sources", header.alias("header")
    )


def compose_digest(
    bodies: DataFrame, headers: DataFrame, footer: str = fixed.DIGEST_FOOTER
) -> DataFrame:
    """Whole text of each digest: header, body and footer."""
    return bodies.join(headers, "digest_id").select(
        "digest_id",
        F.concat("header", "body", F.lit(f"\n\n{fixed.SEPARATOR}\n{footer}")).alias("text"),
    )


def split_messages(
    texts: DataFrame, *keys: str, text: str = "text", limit: int = fixed.MESSAGE_CHARS
) -> DataFrame:
    """Texts as numbered message chunks of at most ``limit`` characters."""
    return texts.select(
        *keys, F.posexplode(message_chunks(text, limit)).alias("chunk_no", "chunk")
    )


def repo_line() -> Column:
    """Report entry of a ranked repository."""
    return F.concat(
        F.col("rank").cast("string"),
        F.lit("\\. ["),
        escape_all_markup("full_name"),
        F.lit("]("),
        F.col("html_url"),
        F.lit(")\n⭐ "),
        F.format_number("stargazers_count", 0),
        F.lit(" \\| 💻 "),
        escape_all_markup(or_default("language", fixed.NO_LANGUAGE)),
        F.lit("\n_"),
        escape_all_markup(ellipsis(or_default("description", fixed.NO_DESCRIPTION))),
        F.lit("_\n"),
    )

