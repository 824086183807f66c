"""Allowing and blocking of URLs by pattern rules, indexed by their rarest literal token.

A rule is a host and a path. It fits its host and all subdomains, if the URL's path begins
with the rule's; ``*`` in a rule's path stands for any run of characters. An empty host fits
all hosts. The longest rule that fits decides; among equally long ones the first in order of
their texts, and of equal rules one that blocks. Where none fits, the verdict is ``default``.

Every label of a rule's host, and every part of its path between two slashes, must stand in
a URL that it fits. Of these tokens the one that the fewest addresses have is the rule's key.
Addresses fetch rules by their tokens, and only those rules run as regular expressions. A
rule without a token has the empty one, which all addresses have.

Addresses are made distinct first, so a page that is listed a million times is judged once.
All is DataFrame operations. Rules are broadcast up to ``FEW``; more are joined by a shuffle.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case;
path: from there up to ``?``, ``#`` or the end. Null URLs and those without ``://`` have an
empty host and path, which no rule fits but one without a host and path. Each row is
judged, repeated ones too, under whatever id it has, null included. Rules with a null host
or path are taken with an empty one. Empty tables give no rows and no rule. Long URLs are
taken whole. Further columns, whatever their names, are passed over by ``judged`` and kept by ``allowed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcast.llm.common import staged

FEW = 100_000  # rules; some 20 MB
LONG = 1_000  # characters of a rule's expression, if rules are broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def tokens(host: Column, segments: Column) -> Column:
    """Labels of a host and parts of a path, told apart by their first character."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("."), x))
    parts = F.transform(F.filter(segments, lambda x: x != ""), lambda x: F.concat(F.lit("/"), x))
    return F.array_distinct(F.concat(labels, parts))


def rule_tokens() -> Column:
    """Of a rule's path only parts that a slash ends and no wildcard touches."""
    parts = F.split("rule_path", "/", -1)
    whole = F.slice(parts, 1, F.size(parts) - 1)
    found = tokens(F.col("rule_host"), F.filter(whole, lambda x: ~F.contains(x, F.lit("*"))))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def address_tokens() -> Column:
    return F.concat(F.array(F.lit("")), tokens(F.col("host"), F.split("path", "/", -1)))


def pattern() -> Column:
    """The regular expression of a rule, over an address's host and path in one."""
    literal = lambda c: F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    host = F.when(F.col("rule_host") == "", F.lit("[^/]*")).otherwise(
        F.concat(F.lit(r"(?:[^/]*\.)?"), literal(F.col("rule_host")))
    )
    path = F.replace(literal(F.col("rule_path")), F.lit(r"\*"), F.lit(".*"))
    ends = F.when(F.col("rule_path") == "", F.lit(r"(?:/|\z)")).otherwise(F.lit(""))
    return F.concat(F.lit(r"(?s)\A"), host, path, ends)


def indexed(rules: DataFrame, addresses: DataFrame, folder: str) -> DataFrame:
    """``key, rule, length, verdict, pattern``: each rule under its rarest token."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rules = rules.select(text("host").alias("rule_host"), text("path").alias("rule_path"), "verdict")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # block is the greater word
    rules = staged(rules.withColumn("tokens", rule_tokens()), folder, "rules")
    keys = staged(rules.select(F.explode("tokens").alias("token")).distinct(), folder, "keys")
    of_addresses = addresses.select(F.explode(address_tokens()).alias("token"))
    counts = of_addresses.join(keys, "token").groupBy("token").agg(F.count("*").alias("n"))
    by_token = rules.withColumn("token", F.explode("tokens")).join(staged(counts, folder, "counts"), "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
    of_rule = by_token.groupBy("rule_host", "rule_path", "verdict").agg(rarest.alias("rarest"))
    rule = F.concat("rule_host", "rule_path").alias("rule")
    length = F.char_length(F.concat("rule_host", "rule_path")).alias("length")
    columns = [F.col("rarest.token").alias("key"), rule, length, "verdict", pattern().alias("pattern")]
    return staged(of_rule.select(*columns), folder, "index")


def fitting(addresses: DataFrame, index: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` of the addresses that a rule fits."""
    size = index.agg(F.count("*").alias("n"), F.max(F.char_length("pattern")).alias("longest")).first()
    if size.n <= FEW and (size.longest or 0) <= LONG:
        index = F.broadcast(index)
    asked = addresses.select("host", "path", F.explode(address_tokens()).alias("key"))
    fetched = asked.join(index, "key").where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    lets = (F.col("verdict") != "block").alias("lets")
    best = F.min(F.struct((-F.col("length")).alias("order"), "rule", lets, "verdict"))
    return fetched.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def verdicts(rows: DataFrame, rules: DataFrame, folder: str, default: str) -> DataFrame:
    """``rows`` (with ``host`` and ``path``) with ``rule`` and ``verdict``; what fits is written to ``folder`` first.

    Both sides of the join come straight from a scan, so Spark can split a hot address.
    """
    addresses = staged(rows.select("host", "path").distinct(), folder, "addresses")
    found = staged(fitting(addresses, indexed(rules, addresses, folder)), folder, "fitting")
    judged = rows.join(found, ["host", "path"], "left")
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def judged(
    pages: DataFrame, rules: DataFrame, folder: str, row_id: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """``row_id, host, path, rule, verdict`` of each page; ``rules`` has ``host, path, verdict`` (allow or block)."""
    rows = pages.select(F.col(row_id).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    found = verdicts(rows, rules, folder, default)
    return found.select(F.col("_id").alias(row_id), "host", "path", "rule", "verdict")


def allowed(pages: DataFrame, rules: DataFrame, folder: str, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages whose verdict is to allow them, with all their columns."""
    rows = pages.select(F.struct("*").alias("_row"), host_of(url).alias("host"), path_of(url).alias("path"))
    return verdicts(rows, rules, folder, default).where("verdict = 'allow'").select("_row.*")
