"""Rules on URLs against a plain loop over all rules."""

import random
import re

import pytest
from quillcast.llm import queries, url_rules
from quillcast.llm.common import scratch
from conftest import SF_DIR

PAGE = "page_id bigint, url string, host string, rule string, _id string"
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("org", "", "block"),
    ("org", "/a/*/c", "allow"),
    ("", "/ads/", "block"),
    ("", "*track", "block"),
    ("b.org", "/a", "allow"),
    ("x.org", "/a", "block"),
    ("x+y.org", "/(a)/[b]", "block"),
    (None, "/null/", "block"),
    ("ex.com", None, "block"),
    ("same.com", "/a", "allow"),
    ("same.com", "/a", "block"),
]
URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "HTTP://EXAMPLE.NET/en/1",
    "http://example.net/en",
    "http://example.net",
    "http://notexample.net/EN/?q=/en/",
    "http://É.Net/x",
    "https://a.b.org/a/b/c?x",
    "https://a.b.org/abc",
    "https://x.org/a",
    "https://borg/a",
    "ftp://x+y.org/(a)/[b]c",
    "ftp://x+y.org/a/b",
    "http://h.com/ads/x",
    "http://h.com/x/ads/",
    "http://h.com/xtrack#y",
    "http://h.com/null/z",
    "http://ex.com",
    "http://ex.com:80/",
    "http://same.com/ab",
    "http://a://b.net/x",
    "http://multi.net\n/line\n",
    "http://long.net/" + "a/" * 20_000,
]


def judged(url, rules, default="allow"):
    m = re.search(r"\A.*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m.group(1)), m.group(2)) if m else ("", "")
    fits = []
    for h, p, verdict in rules:
        h, p = h or "", p or ""
        at_host = h == "" or host == h or host.endswith("." + h)
        if at_host and re.match("".join(".*" if c == "*" else re.escape(c) for c in p), path, re.S):
            fits.append((-len(h + p), h + p, verdict != "block", verdict))
    best = min(fits, default=(0, None, None, default))
    return host, path, best[1], best[3]


def rows_of(spark, urls):
    rows = [(i, u, "clash", "clash", "clash") for i, u in enumerate(urls)]
    rows += [rows[4], (None, "http://example.net/en/1", None, None, None), (None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, PAGE).repartition(3)


@pytest.mark.parametrize("few", [0, url_rules.FEW])
def test_rules_against_a_loop(spark, monkeypatch, few):
    monkeypatch.setattr(url_rules, "FEW", few)
    rng = random.Random(3)
    labels, parts = ["a", "b", "org", "net", "example", "ex", "com"], ["a", "b", "ads", "en", "c", ""]
    many = [
        f"http://{'.'.join(rng.choices(labels, k=rng.randint(1, 4)))}/{'/'.join(rng.choices(parts, k=rng.randint(0, 4)))}"
        for _ in range(400)
    ]
    rows, pages = rows_of(spark, URLS + many)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string").repartition(2)
    found = url_rules.judged(pages, rules, scratch(spark))
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(r[0], *judged(r[1], RULES)) for r in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_allowed_pages_keep_their_columns(spark):
    rows, pages = rows_of(spark, URLS)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = url_rules.allowed(pages, rules, scratch(spark))
    assert found.columns == pages.columns
    want = [r for r in rows if judged(r[1], RULES)[3] == "allow"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_empty_tables_and_other_defaults(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    rows, pages = rows_of(spark, URLS)
    found = url_rules.judged(pages, none, scratch(spark), default="block").collect()
    assert [tuple(r)[3:] for r in found] == [(None, "block")] * len(rows)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_rules.judged(pages.limit(0), rules, scratch(spark)).count() == 0


def test_rules_are_kept_under_their_rarest_token(spark):
    urls = [f"http://{h}/news/x" for h in ["a.net"] * 5 + ["rare.net"]]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    addresses = pages.select(url_rules.host_of("url").alias("host"), url_rules.path_of("url").alias("path"))
    rules = spark.createDataFrame(
        [("rare.net", "/news/", "block"), ("net", "/news/x", "block"), ("", "/n", "block"), ("no.such", "/", "block")],
        "host string, path string, verdict string",
    )
    index = {r.rule: r.key for r in url_rules.indexed(rules, addresses, scratch(spark)).collect()}
    assert index["rare.net/news/"] == ".rare"
    assert index["net/news/x"] in (".net", "/news")
    assert index["/n"] == ""
    assert index["no.such/"] in (".no", ".such")


def test_registered_query(spark):
    found = queries.QUERIES["op12_url_rules"](spark, SF_DIR)
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    want = [(p.page_id, *judged(p.url, queries.URL_RULES)) for p in pages]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
