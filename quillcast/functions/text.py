"""Text expressions. All run JVM-side and take a column or its name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillcast import fixed

# The characters that count as blank.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_blank(c: Column | str) -> Column:
    """Trim every kind of blank, where ``trim`` alone would only trim spaces."""
    return F.btrim(as_col(c), F.lit(BLANKS))


def plain_text(c: Column | str) -> Column:
    """Text without tags, each run of tags and blanks being one space."""
    text = F.regexp_replace(as_col(c), "<[^>]+>", " ")
    # The same characters as BLANKS, in the form that is fastest to match.
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def first_non_empty(*cols: Column | str) -> Column:
    """First value that is neither null nor empty, else the empty text."""
    return F.coalesce(*(F.nullif(as_col(c), F.lit("")) for c in cols), F.lit(""))


def or_default(c: Column | str, default: str) -> Column:
    """The value, or ``default`` where it is null or empty."""
    return F.coalesce(F.nullif(as_col(c), F.lit("")), F.lit(default))


def plain_summary(*candidates: Column | str, limit: int = fixed.SUMMARY_CHARS) -> Column:
    """Plain text of the first candidate with content, cut and not trimmed again."""
    return F.substring(plain_text(first_non_empty(*candidates)), 1, limit)


def escape_markup(c: Column | str) -> Column:
    """Escape message markup but leave ``*``, which digests use for bold."""
    return F.regexp_replace(as_col(c), r"([\\_\[\]()~`>#+=|{}.!-])", r"\\$1")


def escape_all_markup(c: Column | str) -> Column:
    """Escape message markup including ``*``."""
    return F.regexp_replace(as_col(c), r"([\\_*\[\]()~`>#+=|{}.!-])", r"\\$1")


def ellipsis(c: Column | str, limit: int = fixed.REPO_TEXT_CHARS) -> Column:
    c = as_col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def thousands(c: Column | str) -> Column:
    return F.format_number(as_col(c), 0)


def contains_any(c: Column | str, words: list[str]) -> Column:
    """True where the text contains one of the words, also inside another word.

    A filter would work the text out again for every word; as the only element
    of an array it is worked out once.
    """
    return F.exists(
        F.array(as_col(c)),
        lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words)),
    )


def words(c: Column | str) -> Column:
    """Lower-case ASCII words and numbers of a text."""
    return F.filter(F.split(F.lower(as_col(c)), "[^a-z0-9]+"), lambda w: w != "")


def leading_sentences(c: Column | str) -> Column:
    """The first one or two sentences, or the whole text where none ends."""
    c = as_col(c)
    head = F.regexp_extract(c, r"^[^.!?]*[.!?]+(\s+[^.!?]*[.!?]+)?", 0)
    return F.coalesce(F.nullif(head, F.lit("")), c)


def message_chunks(c: Column | str, limit: int = fixed.MESSAGE_CHARS) -> Column:
    """Array of message texts of at most ``limit`` characters.

    A chunk is all that is left where that fits, else it ends before the last
    line break within the limit, else at the limit; line breaks between chunks
    are dropped. ``\\G`` makes each match start where the last one ended, so one
    pass over the text finds all chunks.
    """
    c = as_col(c)
    pattern = rf"(?s)\G(.{{1,{limit}}}\z|.{{0,{limit - 1}}}(?=\n)|.{{{limit}}})\n*"
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(
        F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    )
