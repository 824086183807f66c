"""Feed documents to raw entries."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast.functions.text import first_non_empty

# One entry of a feed. Text between CDATA marks may hold any tag.
_ENTRY = (
    r"(?s)<(item|entry)(?=[\s>])"
    r"(?:[^<]++|<!\[CDATA\[(?:[^\]]++|\](?!\]>))*+\]\]>|<(?!/\1>|!\[CDATA\[))*+</\1>"
)

# Both feed dialects in one schema; a missing element reads as null.
_ENTRY_SCHEMA = """
    title struct<_VALUE: string, _type: string>,
    link array<struct<_VALUE: string, _href: string, _rel: string>>,
    guid struct<_VALUE: string, _isPermaLink: string>,
    summary struct<_VALUE: string, _type: string>,
    description string,
    content struct<_VALUE: string, _type: string>,
    `content:encoded` string,
    pubDate string, published string,
    _corrupt string
"""


_CDATA = r"<!\[CDATA\[(?:[^\]]++|\](?!\]>))*+\]\]>"
_COMMENT = rf"(?s)({_CDATA})|<!--.*?-->"
_PIECES = rf"(?s){_CDATA}|(?:[^<]++|<(?!!\[CDATA\[))++|<"
_BARE = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)"
_NESTED = r"""(?s)(<(summary|content)\s[^>]*type=["']xhtml["'][^>]*(?<!/)>)((?:[^<]++|<(?!/\2>|!\[CDATA\[))*+)(</\2>)"""
# Fixed value: the namespace of one dialect, which documents may give any prefix.
_ATOM = "http://www.w3.org/2005/Atom"
_PREFIX = rf"""xmlns:([A-Za-z_][\w.-]*)\s*=\s*["']{_ATOM}["']"""
_NAMED = r"&([A-Za-z][A-Za-z0-9]*);"
# Entities of HTML that feeds use without declaring them, but for those that XML itself has.
_XML_NAMES = ("amp", "lt", "gt", "quot", "apos")
_CODES = {name: code for name, code in name2codepoint.items() if name not in _XML_NAMES}


def _entries(body: Column, prefix: str | None = None) -> Column:
    """The entries of a document, without its comments and the prefix that it gives its entries."""
    plain = F.when(body.contains("<!--"), F.regexp_replace(body, _COMMENT, "$1")).otherwise(body)
    declared = F.regexp_extract(plain, _PREFIX, 1) if prefix is None else F.lit(prefix)
    prefix = F.when(declared != "", declared).when(plain.contains("<atom:entry"), F.lit("atom"))
    prefixed = F.concat(F.lit(rf"(?s)({_CDATA})|(</?)\Q"), prefix, F.lit(r"\E:"))
    has_any = plain.contains(":entry") & prefix.isNotNull()
    plain = F.when(has_any, F.regexp_replace(plain, prefixed, F.lit("$1$2"))).otherwise(plain)
    return F.regexp_extract_all(plain, F.lit(_ENTRY), F.lit(0))


def _numbered(text: Column) -> Column:
    """Entities of HTML by their numbers, each found once; unknown ones stay as they are."""
    codes = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    names = F.regexp_extract_all(text, F.lit(_NAMED), F.lit(1))

    def spelled(name: Column) -> Column:
        code = F.try_element_at(codes, name)
        return F.when(code.isNotNull(), F.concat(F.lit("&#"), code, F.lit(";"))).otherwise(
            F.concat(F.lit("&"), name, F.lit(";"))
        )

    between = F.split(text, _NAMED, -1)
    whole = F.zip_with(between, names, lambda t, n: F.concat(t, F.when(n.isNotNull(), spelled(n)).otherwise("")))
    return F.array_join(whole, "")


def _readable(entry: Column) -> Column:
    """An entry as XML: its ampersands outside CDATA marks repaired, nested markup as text."""

    def repaired(piece: Column) -> Column:
        text = F.when(piece.rlike(_NAMED), _numbered(piece)).otherwise(piece)
        text = F.when(piece.contains("&"), F.regexp_replace(text, _BARE, "&amp;")).otherwise(piece)
        return F.when(piece.startswith("<![CDATA["), piece).otherwise(text)

    pieces = F.transform(F.regexp_extract_all(entry, F.lit(_PIECES), F.lit(0)), repaired)
    entry = F.when(entry.rlike(_BARE), F.array_join(pieces, "")).otherwise(entry)
    nested = F.regexp_replace(entry, _NESTED, r"$1<![CDATA[$3]]>$4")
    return F.when(entry.contains("xhtml"), nested).otherwise(entry)


def read_feed_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed files as (path, body), one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")
    )


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed feed files, with the path of their file."""
    return parse_feeds(read_feed_documents(spark, path), "path")


def read_feed_dump(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Entries of feed files of any size, with the path of their file; each file is read by as many tasks as it fills.

    ``tag`` names the element of an entry (``item`` or ``entry``, with its prefix) in all files. Its end is
    the end of a record, so entries are found across the parts that a file is split into, and
    what is broken spoils one record alone. ``position`` orders the entries of a file and is unique in
    it: from 0 on in a file of one part, with gaps in others.

    Unlike ``read_feeds`` this loses an entry that has the end tag inside CDATA marks, and takes
    a last one that lacks no more than its end tag.
    """
    end, prefix = f"</{tag}>", tag.rpartition(":")[0]
    records = spark.read.option("lineSep", end).text(path)
    in_part = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    # a record is longer than a byte, so the numbers of a part end before the next one begins
    records = records.select(
        F.col("_metadata.file_path").alias("path"),
        (F.col("_metadata.file_block_start") + in_part).alias("position"),
        F.try_element_at(_entries(F.concat("value", F.lit(end)), prefix), F.lit(-1)).alias("entry"),
    )
    return _parsed(records.where("entry is not null"), "path")


def parse_feeds(
    documents: DataFrame, *keys: str, body: str = "body", first: int | None = None
) -> DataFrame:
    """Entries of feed documents, in feed order from position 0.

    With ``first`` only so many raw entries of each document are read, which is
    the feed cap where a source has one document in a run: it takes no shuffle.

    Entries are cut out of the document and read one by one, so a broken
    document still gives the entries before the break. Bare ampersands, entities of
    HTML and nested markup are read as text; an entry that is no XML even so is lost
    alone. Comments hold no entries. Documents without any entry give no rows.
    """
    found = _entries(F.col(body))
    if first is not None:
        found = F.slice(found, 1, first)
    return _parsed(documents.select(*keys, F.posexplode(found).alias("position", "entry")), *keys)


def _parsed(cut: DataFrame, *keys: str) -> DataFrame:
    """Fields of entries (``position``, ``entry``)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = cut.select(
        *keys,
        F.col("position").cast("bigint").alias("position"),
        F.from_xml(_readable(F.col("entry")), _ENTRY_SCHEMA, options).alias("e"),
    )
    # An absent title stays null, an empty one stays empty.
    title = F.when(F.col("e.title").isNotNull(), F.coalesce(F.col("e.title._VALUE"), F.lit("")))
    return parsed.where("e._corrupt is null").select(
        *keys,
        "position",
        _entry_link().alias("link"),
        title.alias("title"),
        F.col("e.summary._VALUE").alias("summary"),
        F.coalesce("e.description", "e.content._VALUE", "e.content:encoded").alias("description"),
        first_non_empty("e.pubDate", "e.published").alias("published"),
    )


def _entry_link() -> Column:
    """Link of an entry: its text, else the alternate reference, else a permalink id."""
    links = F.col("e.link")
    texts = F.filter(F.transform(links, lambda x: x["_VALUE"]), lambda v: v.isNotNull())
    alternates = F.transform(
        F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"),
        lambda x: x["_href"],
    )
    permalink = F.when(
        F.coalesce(F.col("e.guid._isPermaLink"), F.lit("true")) == "true", F.col("e.guid._VALUE")
    )
    return F.coalesce(F.get(texts, F.lit(0)), F.get(alternates, F.lit(0)), permalink)


def feeds_without_entries(documents: DataFrame, *keys: str, body: str = "body") -> DataFrame:
    """Keys of the documents that give no entry at all, broken or empty."""
    return documents.where(F.coalesce(F.size(_entries(F.col(body))), F.lit(0)) == 0).select(*keys)
