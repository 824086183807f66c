"""Rules that are easy to get wrong, on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from quillcast import fixed
from quillcast.operators import caps, compose, links, near_dup, novelty, registry, reports, seen_set, topics, trending

DAY0 = datetime(2025, 1, 1)


def day(n):
    return DAY0 + timedelta(days=n)


def articles(spark, rows):
    """Articles from (digest_id, source_id, position, url, title, summary)."""
    df = spark.createDataFrame(
        rows, "digest_id bigint, source_id bigint, position bigint, url string, title string, summary string"
    )
    return df.withColumn("url_hash", F.sha2("url", 256)).withColumn(
        "source_name", F.concat(F.lit("S"), "source_id")
    )


def marks(spark, rows):
    return spark.createDataFrame(rows, "url_hash string, marked_at timestamp_ntz")


# Links and caps


def link_page(spark, body):
    return spark.createDataFrame([(1, 1, body)], "source_id bigint, page_id bigint, body string")


GOLDEN = "[A](https://x.example/1) [B](http://y.example/2) [A2](https://x.example/1) [C](/rel)"


def test_markdown_links_and_articles(spark):
    page = link_page(spark, GOLDEN)
    found = links.markdown_links(page, "source_id", "page_id")
    assert found.count() == 3
    assert [r.title for r in links.crawl_articles(found).orderBy("position").collect()] == ["A", "B"]
    top = links.top_links(page, "source_id", "page_id")
    assert [(r.pos, r.title) for r in top.collect()] == [(0, "A"), (1, "B")]


def test_page_links(spark):
    html = (
        """<a href="/a">A <b>b</b></a><a href='it"s'>B</a><A class="x" HREF = "?q">C</A><a name="n">no</a>"""
        """<a href="/open">open <a href="/d">D</a><a href="/e"> </a><abbr>x</abbr><a href="/f">f"""
    )
    df = spark.createDataFrame([(1, "https://x.example/p/q", html)], "page_id int, url string, html string")
    got = [(r.title, r.url) for r in links.page_links(df, "page_id").orderBy("pos").collect()]
    assert got == [
        ("A b", "https://x.example/a"),
        ("B", 'https://x.example/p/it"s'),
        ("C", "https://x.example/p/q?q"),
        ("D", "https://x.example/d"),
    ]


def test_page_with_many_open_anchors_is_read_in_one_pass(spark):
    html = '<a href="/x">' * 100_000
    df = spark.createDataFrame([(1, "https://x.example/", html)], "page_id int, url string, html string")
    assert links.page_links(df, "page_id").count() == 0


def test_page_cap_comes_after_dropping_repeats(spark):
    body = "[a](https://x.example/1) " * 5 + "[b](https://x.example/2) [c](https://x.example/3)"
    found = links.markdown_links(link_page(spark, body), "source_id", "page_id")
    assert [r.title for r in links.crawl_articles(found, 2).orderBy("position").collect()] == ["a", "b"]


def test_cap_inside_pages_changes_nothing(spark):
    """Pages that repeat each other's links, capped inside each page first or not."""
    rows = [
        (p % 3, p, " ".join(f"[t{i}](https://x.example/{(p * i) % 17})" for i in range(p % 11 + 3)))
        for p in range(60)
    ]
    pages = spark.createDataFrame(rows, "source_id bigint, page_id bigint, body string")
    whole = links.crawl_articles(links.markdown_links(pages, "source_id", "page_id"), 7)
    early = links.crawl_articles(links.top_links(pages, "source_id", "page_id", n=7), 7)
    assert sorted(whole.collect()) == sorted(early.collect())


def test_repeats_within_a_run_stay(spark):
    new = articles(spark, [(1, 1, 0, "u", "a", ""), (1, 1, 1, "u", "b", "")])
    empty = new.select("url_hash").limit(0)
    assert novelty.filter_new_articles(new, empty, empty).count() == 2
    ledger = novelty.ledger_append(new, empty, DAY0).collect()
    assert [r.title for r in ledger] == ["a"]


def test_digest_cap_and_overflow_are_the_whole(spark):
    rows = [(d, s, p, f"{d}/{s}/{p}", "", "") for d in range(3) for s in range(4) for p in range(5 * d + 1)]
    new = articles(spark, rows)
    shown, rest = caps.digest_cap(new, 7), caps.digest_overflow(new, 7)
    assert sorted(r.url for r in shown.unionByName(rest).collect()) == sorted(r[3] for r in rows)
    for d in range(3):
        ordered = sorted((r[1], r[2]) for r in rows if r[0] == d)
        got = shown.where(F.col("digest_id") == d).select("source_id", "position").collect()
        assert sorted(map(tuple, got)) == ordered[:7]


# Novelty and the seen-set


def test_ledger_keys_stay_unique(spark):
    first = articles(spark, [(1, 1, i, f"u{i % 3}", "", "") for i in range(9)])
    ledger = novelty.ledger_append(first, first.select("url_hash").limit(0), DAY0)
    again = novelty.ledger_append(first, ledger, day(1))
    assert ledger.count() == 3 and again.count() == 0


@pytest.mark.parametrize(
    "times, at, live",
    [
        ((0, 20, 45), 50, {"h1", "h2", "h3"}),
        ((0, 20, 45), 74, {"h1", "h2", "h3"}),
        ((0, 20, 45), 75, set()),
        ((0, 20, 55), 56, {"h3"}),
        ((0, 30, 31), 32, {"h2", "h3"}),
        ((0, 20, 45), 30, {"h1", "h2"}),
    ],
)
def test_time_limit_is_on_the_whole_set(spark, times, at, live):
    df = marks(spark, [(f"h{i}", day(t)) for i, t in enumerate(times, 1)])
    assert {r.url_hash for r in seen_set.seen_set_live(df, day(at)).collect()} == live


def test_time_limit_per_key_differs(spark):
    df = marks(spark, [("h1", day(0)), ("h2", day(20)), ("h3", day(45))])
    got = {r.url_hash for r in seen_set.keys_live_each(df, day(49)).collect()}
    assert got == {"h2", "h3"}


def test_live_set_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = [(t, f"k{rnd.randint(0, 9)}", DAY0 + timedelta(minutes=rnd.randint(0, 6000))) for t in range(25) for _ in range(rnd.randint(1, 40))]
    asof, ttl = DAY0 + timedelta(minutes=5900), timedelta(hours=5)
    want = set()
    for tenant in range(25):
        own = sorted((m, k) for t, k, m in rows if t == tenant and m <= asof)
        live, last = set(), None
        for m, k in own:
            if last is not None and m - last >= ttl:
                live = set()
            live.add(k)
            last = m
        if last is not None and last + ttl > asof:
            want |= {(tenant, k) for k in live}
    df = spark.createDataFrame(rows, "tenant int, url_hash string, marked_at timestamp_ntz")
    got = seen_set.seen_set_live(df, asof, "5 hours", ["tenant"]).collect()
    assert {(r.tenant, r.url_hash) for r in got} == want and len(got) == len(want)


def test_ttl_dedup(spark):
    arrivals = spark.createDataFrame(
        [("a", day(40)), ("a", day(39)), ("b", day(40)), ("c", day(40))], "url_hash string, arrived_at timestamp_ntz"
    )
    known = marks(spark, [("a", day(5)), ("b", day(20)), ("b", day(1))])
    got = seen_set.ttl_dedup(arrivals, known, day(38)).collect()
    assert {(r.url_hash, r.arrived_at) for r in got} == {("a", day(39)), ("c", day(40))}


def test_sent_today_uses_the_zone(spark):
    ledger = spark.createDataFrame(
        [(datetime(2025, 1, 2, 4, 59),), (datetime(2025, 1, 2, 5, 0),), (datetime(2025, 1, 2, 12, 0),)], "sent_at timestamp_ntz"
    )
    asof = datetime(2025, 1, 2, 20, 0)
    assert reports.count_sent_today(ledger, asof, "America/Toronto").first()[0] == 2
    assert reports.count_sent_today(ledger, asof).first()[0] == 3


# Registry


def test_registration_lines(spark):
    lines = ["https://h.example rss", "https://h.example My Blog", "https://h.example MIT Review CRAWL", "https://h.example"]
    df = spark.createDataFrame(list(enumerate(lines)), "seq bigint, line string")
    got = [(r.name, r.type) for r in registry.parse_registrations(df).orderBy("seq").collect()]
    assert got == [("rss", "rss"), ("My Blog", "rss"), ("MIT Review", "crawl"), (None, None)]


def sources(spark, rows):
    return spark.createDataFrame(
        rows, "source_id bigint, name string, url string, type string, active boolean"
    )


def test_add_sources(spark):
    have = sources(spark, [(4, "old", "https://old.example", "rss", False)])
    lines = ["https://n.example N", "https://old.example Again", "https://n.example Twice", "ftp://f.example F", "https://m.example M crawl"]
    df = spark.createDataFrame([(i * 1_500_000, line) for i, line in enumerate(lines)], "seq bigint, line string")
    got = registry.add_sources(df, have).orderBy("source_id").collect()
    assert [(r.source_id, r.name, r.type) for r in got] == [(5, "N", "rss"), (6, "M", "crawl")]
    assert registry.add_sources(df, have.limit(0)).agg(F.min("source_id")).first()[0] == 1
    results = registry.registration_results(df.unionByName(df.limit(1).selectExpr("seq - 1 AS seq", "'x' AS line")), have)
    assert [(r.outcome, r.source_id) for r in results.orderBy("seq").collect()] == [
        ("usage", None), ("added", 5), ("duplicate", None), ("duplicate", None), ("invalid", None), ("added", 6)
    ]


def test_last_switch_counts(spark):
    have = sources(spark, [(1, "a", "u1", "rss", True), (2, "b", "u2", "rss", False), (3, "c", "u3", "rss", True)])
    log = spark.createDataFrame(
        [(1, "enable", DAY0, 1), (1, "disable", DAY0, 2), (2, "enable", day(1), 3), (9, "enable", day(1), 4)],
        "source_id bigint, action string, ts timestamp_ntz, seq bigint",
    )
    state = registry.registry_state(have, log).orderBy("source_id").collect()
    assert [r.active for r in state] == [False, True, True]
    assert [r.source_id for r in registry.unknown_mutations(have, log).collect()] == [9]


def test_seed_only_an_empty_registry(spark):
    defaults = registry.default_sources(spark)
    have = sources(spark, [(1, "a", "u", "rss", False)])
    assert registry.seed_if_empty(have, defaults).count() == 1
    assert registry.seed_if_empty(have.limit(0), defaults).count() == len(fixed.DEFAULT_SOURCES)


# Trending


def test_repo_paths(spark):
    html = '<article class="r">\n<a href="/o/r">z</a></article><a href="/p/q">\n<span>p</span>'
    df = spark.createDataFrame([(1, html)], "page_no bigint, html string")
    assert [r.repo_path for r in links.repo_paths(df).orderBy("pos").collect()] == ["o/r", "p/q"]


def test_repeat_uses_up_a_place(spark):
    rows = [(1, i, p) for i, p in enumerate("abc")] + [(2, i, p) for i, p in enumerate("bde")]
    paths = spark.createDataFrame(rows, "page_no bigint, pos int, repo_path string")
    got = trending.repo_candidates(paths, 2).orderBy("page_no", "pos").collect()
    assert [r.repo_path for r in got] == ["a", "b", "d"]


def repos(spark, rows):
    return spark.createDataFrame(
        rows,
        "full_name string, description string, topics array<string>, stargazers_count bigint, language string, "
        "html_url string, page_no bigint, pos int",
    )


def test_keywords_match_inside_words_and_across_parts(spark):
    df = repos(spark, [("x/y", "we maintain", None, 1, None, "", 1, 1), ("i/q", "x a", [], 1, None, "", 1, 2), ("x/y", None, ["Q"], 1, None, "", 1, 3)])
    assert sorted(r.pos for r in trending.keyword_filter(df, ["ai"]).collect()) == [1, 2]


def test_ties_keep_the_order_found(spark):
    rows = [(f"r{i}", "", [], 5 if i % 2 else 9, None, "", i // 4, i % 4) for i in range(12)]
    want = [r[0] for r in sorted(rows, key=lambda r: -r[3])][:7]
    for seed in range(3):
        mixed = repos(spark, rows).orderBy(F.rand(seed)).repartition(5)
        assert [r.full_name for r in trending.rank_repos(trending.top_repos(mixed, 7)).orderBy("rank").collect()] == want


def test_report_texts(spark):
    df = repos(spark, [("o/r_1", "x" * 81, [], 12345, None, "https://g.example/o", 1, 1)])
    report = trending.repo_report(trending.rank_repos(df)).first()[0]
    assert report == (
        "⭐ *Trending AI/ML GitHub Repos* — this week\n\n1\\. [o/r\\_1](https://g.example/o)\n"
        "⭐ 12,345 \\| 💻 N/A\n_" + "x" * 80 + "\\.\\.\\._\n"
    )
    assert trending.repo_report(trending.rank_repos(df.limit(0))).first()[0] == "❌ No trending repos found."


# Composition


def test_topics(spark):
    df = articles(spark, [(1, 1, 0, "u", "New paper", "a study of data"), (1, 1, 1, "v", "x", "y"), (1, 1, 2, "w", "model", "data")])
    got = [r.topic_no for r in topics.topic_assign(df).orderBy("position").collect()]
    assert got == [1, 5, 2]


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, 1, 0, "a", "", base),
        (1, 1, 1, "b", "", base + " end"),
        (1, 2, 0, "c", "", base),
        (1, 2, 1, "d", "", "something else"),
        (2, 1, 0, "e", "", base),
    ]
    df = articles(spark, rows)
    pairs = near_dup.near_dup_pairs(df).collect()
    assert {(r.source_a, r.position_a, r.source_b, r.position_b) for r in pairs} == {(1, 0, 1, 1)}
    sets = near_dup.near_dup_sets(df).collect()
    assert {(r.source_id, r.position): (r.source_rep, r.position_rep) for r in sets if r.digest_id == 1} == {
        (1, 0): (1, 0), (1, 1): (1, 1), (2, 0): (1, 0), (2, 1): (2, 1)
    }
    for keep in (near_dup.near_dup_keep, near_dup.near_dup_keep_shown):
        assert sorted(r.url for r in keep(df).collect()) == ["b", "d", "e"]


def chain(n):
    """Texts each similar to the next one and to no other."""
    words = [f"w{i}" for i in range(30 + 2 * n)]
    return [" ".join(words[2 * i : 2 * i + 30]) for i in range(n)]


def test_groups_are_connected_not_pairwise(spark):
    """A is similar to B and B to C: one of the three stays, the one with the longest summary."""
    texts = chain(30)
    rows = [(1, 1, i, f"u{i}", "", t) for i, t in enumerate(texts)] + [(1, 2, 0, "alone", "", "other words here")]
    rows += [(2, 1, i, f"v{i}", "", t) for i, t in enumerate(texts) if i != 15]
    rows += [(2, 3, 0, "null", None, None), (2, 3, 1, "empty", "", "")]
    df = articles(spark, rows)
    longest = lambda some: max(some, key=lambda r: (len(r[5]), -r[1], -r[2]))[3]
    left = longest([r for r in rows if r[0] == 2 and r[1] == 1 and r[2] < 15])
    right = longest([r for r in rows if r[0] == 2 and r[1] == 1 and r[2] > 15])
    want = sorted([longest(rows[:30]), "alone", left, right, "empty"])
    assert sorted(r.url for r in near_dup.near_dup_keep(df).collect()) == want
    assert sorted(r.url for r in near_dup.near_dup_keep_shown(df).collect()) == want


def test_copies_make_no_pairs(spark):
    text = chain(1)[0]
    df = articles(spark, [(1, i, 0, f"u{i}", "", text) for i in range(600)] + [(1, 601, 0, "x", "", text + " end")])
    assert near_dup.near_dup_pairs(df).count() == 1
    assert near_dup.near_dup_sets(df).where("source_rep = 0").count() == 600
    assert [r.url for r in near_dup.near_dup_keep(df).collect()] == ["x"]


def test_payload_is_json_in_order(spark):
    import json

    df = articles(spark, [(1, 2, 0, "u2", 'q"2', None), (1, 1, 5, "u1", None, "s/1")])
    got = json.loads(compose.prompt_payload(df).first().payload)
    assert got == [
        {"title": "", "summary": "s/1", "source": "S1", "url": "u1"},
        {"title": 'q"2', "summary": "", "source": "S2", "url": "u2"},
    ]


def test_given_text_or_headlines(spark):
    df = articles(spark, [(1, 1, 0, "u", None, ""), (2, 1, 0, "v", "T", "")])
    given = spark.createDataFrame([(2, "body"), (1, "")], "digest_id bigint, body string")
    got = {r.digest_id: r.body for r in compose.digest_or_fallback(df, given).collect()}
    assert got == {1: "⚠️ Summarisation failed, here are raw headlines:\n\n• Untitled (S1)", 2: "body"}


def test_near_duplicates_beyond_the_cap(spark):
    """All articles of a digest are compared, against every pair of them."""
    import random

    rng = random.Random(4)
    rows, texts = [], [[f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 12, 30]))] for _ in range(25)]
    for i in range(150):
        text = list(rng.choice(texts))
        if rng.random() < 0.5:
            text[rng.randrange(len(text))] = f"x{rng.randrange(3)}"
        rows.append((i % 2, i // 10, i, f"u{i}", "", " ".join(text)))
    sets = {r[2]: {tuple(w[k : k + 3]) for k in range(max(len(w) - 2, 1))} for r in rows for w in [r[5].split()]}
    reps, pairs = {}, set()
    for r in rows:
        reps.setdefault((r[0], frozenset(sets[r[2]])), r[2])
    group = {r[2]: r[2] for r in rows}
    for a in rows:
        for b in rows:
            x, y = sets[a[2]], sets[b[2]]
            if a[0] == b[0] and a[2] < b[2] and len(x & y) / len(x | y) >= 0.8:
                if x != y and a[2] in reps.values() and b[2] in reps.values():
                    pairs.add((a[0], a[2], b[2], len(x & y) / len(x | y)))
                old, new = group[b[2]], group[a[2]]
                group = {k: new if v == old else v for k, v in group.items()}
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r[5]), r[1], r[2])):
        best.setdefault(group[r[2]], r[2])
    df = articles(spark, rows)
    got = near_dup.near_dup_pairs(df).collect()
    assert sorted((r.digest_id, r.position_a, r.position_b, r.jaccard) for r in got) == sorted(pairs)
    assert any(p[1] > 100 for p in pairs) and any(p[3] < 1 for p in pairs)
    for keep in (near_dup.near_dup_keep, near_dup.near_dup_keep_shown):
        kept = keep(df)
        assert kept.columns == df.columns
        assert sorted(r.position for r in kept.collect()) == sorted(best.values())


def test_near_duplicates_make_shingles_once(spark, tmp_path):
    """What is returned reads written keys: no text is cut into words again."""
    df = articles(spark, [(1, 1, i, f"u{i}", "", t) for i, t in enumerate(chain(5))])
    for k, f in enumerate((near_dup.near_dup_sets, near_dup.near_dup_pairs, near_dup.near_dup_keep)):
        got = f(df, folder=str(tmp_path / f"{k}"))
        assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert got.count() == [5, 4, 1][k]
