"""Scalar expressions against plain Python on small and random texts."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from quillcast.functions import text as X
from quillcast.functions import times as D
from quillcast.functions import urls as U


def values(spark, texts, expr):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def random_texts(alphabet, n, size, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(alphabet, k=rnd.randint(0, size))) for _ in range(n)]


def test_blanks_and_tags(spark):
    alphabet = list(X.BLANKS) + list("ab<>/ß日😀")
    texts = random_texts(alphabet, 2000, 40)
    assert values(spark, texts, X.trim_blank("t")) == [t.strip() for t in texts]
    clean = [" ".join(re.sub("<[^>]+>", " ", t).split())[:20] for t in texts]
    assert values(spark, texts, X.plain_summary("t", limit=20)) == clean


def test_long_tag_runs_do_not_overflow(spark):
    text = "<b></b>\n" * 50_000 + "x"
    assert values(spark, [text], X.plain_summary("t")) == ["x"]


def test_summary_is_cut_but_not_trimmed_again(spark):
    assert values(spark, ["ab cd"], X.plain_summary("t", limit=3)) == ["ab "]


def test_escapers(spark):
    text = "a_b*c.d-e\\f"
    assert values(spark, [text], X.escape_markup("t")) == ["a\\_b*c\\.d\\-e\\\\f"]
    assert values(spark, [text], X.escape_all_markup("t")) == ["a\\_b\\*c\\.d\\-e\\\\f"]


def test_escape_then_unescape_gives_the_text(spark):
    texts = random_texts(list("\\_*[]()~`>#+=|{}.!-ab \n"), 500, 30)
    for escaper in (X.escape_markup, X.escape_all_markup):
        back = [re.sub(r"\\(.)", r"\1", v) for v in values(spark, texts, escaper("t"))]
        assert back == texts


def brute_chunks(text, limit):
    """The rule for one message, then the rest in the same way."""
    head, tail = text[:limit], text[limit:]
    if not tail:
        return [text]
    before, line_break, after = head.rpartition("\n")
    first, rest = (before, after + tail) if line_break else (head, tail)
    rest = rest.lstrip("\n")
    return [first, *(brute_chunks(rest, limit) if rest else [])]


@pytest.mark.parametrize("limit", [1, 6, 10])
def test_chunks(spark, limit):
    golden = ["", "abc", "abcdefgh", "aaaa\nbbbb\n\ncc", "\nabcdefgh", "\n" * 20, "abcdef\n\n"]
    texts = golden + random_texts(list("abc日😀\n\n"), 1500, 45)
    got = values(spark, texts, X.message_chunks("t", limit))
    assert got == [brute_chunks(t, limit) for t in texts]
    for text, chunks in zip(texts, got):
        assert all(len(c) <= limit for c in chunks)
        assert "".join(chunks).replace("\n", "") == text.replace("\n", "")


def test_chunks_of_a_long_text(spark):
    text = ("word " * 30 + "\n") * 15_000
    assert values(spark, [text], X.message_chunks("t")) == [brute_chunks(text, 4096)]


def test_golden_chunks(spark):
    cases = {
        "": [""],
        "abcdefgh": ["abcdef", "gh"],
        "aaaa\nbbbb\n\ncc": ["aaaa", "bbbb\n", "cc"],
        "\nabcdefgh": ["", "abcdef", "gh"],
    }
    assert values(spark, list(cases), X.message_chunks("t", 6)) == list(cases.values())


def test_published_at(spark):
    cases = {
        "Fri, 09 May 2025 08:00:00 GMT": datetime(2025, 5, 9, 8),
        "Fri, 9 May 2025 08:00:00 GMT": datetime(2025, 5, 9, 8),
        "09 May 2025 08:00:00 +0200": datetime(2025, 5, 9, 6),
        "Fri, 09 May 2025 08:00 GMT": datetime(2025, 5, 9, 8),
        "2025-05-09T08:00:00Z": datetime(2025, 5, 9, 8),
        "2025-05-09T08:00:00-04:00": datetime(2025, 5, 9, 12),
        "junk": None,
        "": None,
        "Fri, 45 May 2025 08:00:00 GMT": None,
    }
    assert values(spark, list(cases), D.published_at("t")) == list(cases.values())


def test_published_at_in_another_session_zone(spark, conf):
    conf("spark.sql.session.timeZone", "Asia/Tokyo")
    assert values(spark, ["09 May 2025 08:00:00 GMT"], D.published_at("t")) == [datetime(2025, 5, 9, 8)]


def test_digest_day_is_the_first_run_at_or_after(spark):
    at = lambda s: F.to_timestamp_ntz(F.col("t"))
    texts = ["2025-05-09 12:00:00", "2025-05-09 12:00:00.000001", "2025-05-09 11:59:59", "2025-01-09 13:00:00"]
    days = values(spark, texts, D.digest_day(at("t"), "08:00", "America/Toronto").cast("string"))
    assert days == ["2025-05-09", "2025-05-10", "2025-05-09", "2025-01-09"]


def test_time_of_day(spark):
    cases = {"8:05": True, "23:59": True, "24:00": False, "12:60": False, "8:5": False, "8.05": False, "x": False}
    assert values(spark, list(cases), D.is_time_of_day("t")) == list(cases.values())


def test_url_tests_differ(spark):
    cases = {
        "https://a.example/x": (True, True),
        "HTTP://a.example": (True, True),
        "ftp://a.example/x": (False, True),
        "https://": (False, False),
        "https:///x": (False, False),
        "a.example/x": (False, False),
        "mailto:a@b.example": (False, False),
        "https://[::1": (False, True),
        "https://ä.example/ö ü|": (True, True),
    }
    got = values(spark, list(cases), F.struct(U.is_web_url("t"), U.has_scheme_host("t")))
    assert [tuple(r) for r in got] == list(cases.values())


def test_resolve_url(spark):
    from urllib.parse import urljoin

    bases = ["https://a.example/b/c?d#e", "https://a.example", "https://a.example/b/"]
    hrefs = ["/x", "x", "//o.example/x", "https://z.example/", "?q=1", "#f", "x/y?z"]
    for base in bases:
        got = values(spark, hrefs, U.resolve_url("t", F.lit(base)))
        assert got == [urljoin(base, h) for h in hrefs]


def test_small_texts(spark):
    assert values(spark, ["x" * 80, "x" * 81], X.ellipsis("t")) == ["x" * 80, "x" * 80 + "..."]
    assert values(spark, ["One. Two! Three.", "none"], X.leading_sentences("t")) == ["One. Two!", "none"]
    assert values(spark, [None, "", "a"], X.or_default("t", "d")) == ["d", "d", "a"]
    assert values(spark, ["1234567"], X.thousands(F.col("t").cast("bigint"))) == ["1,234,567"]


def test_exact_times(spark, conf):
    """The hour that clocks tell twice, two-digit years, and times with a zone."""
    from datetime import timedelta, timezone

    for zone in ("UTC", "America/New_York"):
        conf("spark.sql.session.timeZone", zone)
        cases = {
            "Sun, 03 Nov 2024 06:30:00 GMT": datetime(2024, 11, 3, 6, 30),
            "Sun, 03 Nov 2024 05:30:00 GMT": datetime(2024, 11, 3, 5, 30),
            "2024-11-03T06:30:00": datetime(2024, 11, 3, 6, 30),
            "2024-11-03T01:30:00-05:00": datetime(2024, 11, 3, 6, 30),
            "Fri, 09 May 25 08:00:00 GMT": datetime(2025, 5, 9, 8),
            "9 May 2025 8:00:00 EST": datetime(2025, 5, 9, 13),
        }
        assert values(spark, list(cases), D.published_at("t")) == list(cases.values())
    aware = datetime(2025, 5, 9, 8, tzinfo=timezone(timedelta(hours=-4)))
    assert spark.range(1).select(D.at(aware)).first()[0] == datetime(2025, 5, 9, 12)
