"""Feed files, malformed and in both dialects."""

from datetime import datetime

from pyspark.sql import functions as F
from quillcast.operators.articles import normalise
from quillcast.operators.caps import feed_cap
from quillcast.sources import feeds, repos

A = (
    '<rss version="2.0"><channel><title>Feed A</title>'
    "<item><title> One </title><link>https://a.example/1 </link>"
    "<description><![CDATA[<p>Hello <b>w</b></p>]]></description>"
    "<pubDate>Fri, 09 May 2025 08:00:00 GMT</pubDate></item>"
    "<item><title>NoLink</title><description>x</description></item></channel></rss>"
)
B = '<rss version="2.0"><channel><title>Feed B</title><item><link>https://b.example/1</link><title/></item></channel></rss>'
C = "<rss><channel><item><title>bro"
PARTIAL = "<rss><channel><item><title>ok</title><link>https://p.example/1</link></item><item><title>bro"
ATOM = (
    '<feed xmlns="http://www.w3.org/2005/Atom"><entry>'
    '<link rel="self" href="https://at.example/self"/><link rel="alternate" href="https://at.example/1"/>'
    '<title type="html">T1</title><summary type="html">s</summary>'
    "<published>2025-05-09T08:00:00Z</published></entry></feed>"
)


def parsed(spark, *bodies, **options):
    docs = spark.createDataFrame(list(enumerate(bodies)), "source_id bigint, body string")
    return feeds.parse_feeds(docs, "source_id", **options)


def test_feed_files(spark, tmp_path):
    for name, body in [("a", A), ("b", B), ("c", C)]:
        (tmp_path / f"{name}.xml").write_text(body)
    entries = feeds.read_feeds(spark, str(tmp_path)).withColumn("source_id", F.lit(1))
    rows = normalise(entries).orderBy("url").collect()
    assert [(r.position, r.title, r.url, r.summary, r.published_at) for r in rows] == [
        (0, "One", "https://a.example/1", "Hello w", datetime(2025, 5, 9, 8)),
        (0, "", "https://b.example/1", "", None),
    ]


def test_partial_feed_keeps_entries_before_the_break(spark):
    assert [r.url for r in normalise(parsed(spark, PARTIAL)).collect()] == ["https://p.example/1"]


def test_broken_entry_is_lost_alone(spark):
    body = "<rss><item><title>a <b </title><link>https://x.example/0</link></item><item><link>https://x.example/1</link></item></rss>"
    assert [(r.position, r.link) for r in parsed(spark, body).collect()] == [(1, "https://x.example/1")]


def test_ampersands_and_entities(spark):
    item = "<item><title>{}</title><link>https://x.example/{}</link><description><![CDATA[{}]]></description></item>"
    cases = [
        ("a & b", "?a=1&b=2", "c & d", "a & b", "?a=1&b=2", "c & d"),
        ("x&nbsp;y &mdash; z", "1", "&nbsp;", "x y — z", "1", "&nbsp;"),
        ("&amp; &#233; &lt;", "2", "</item>&", "& é <", "2", "</item>&"),
        ("&unknown; AT&T", "3", "", "&unknown; AT&T", "3", ""),
    ]
    body = "<rss>" + "".join(item.format(*c[:3]) for c in cases) + "</rss>"
    rows = parsed(spark, body).orderBy("position").collect()
    assert [(r.position, r.title, r.link, r.description) for r in rows] == [
        (i, c[3], f"https://x.example/{c[4]}", c[5]) for i, c in enumerate(cases)
    ]


def test_comments_prefixes_and_nested_markup(spark):
    item = "<item><link>https://x.example/{}</link>{}</item>"
    body = "<rss><!-- " + item.format(0, "") + " -->" + item.format(1, "<description><![CDATA[<!-- a -->]]></description>") + "</rss>"
    assert [(r.position, r.link, r.description) for r in parsed(spark, body).collect()] == [
        (0, "https://x.example/1", "<!-- a -->")
    ]
    prefixed = ATOM.replace("</", "</atom:").replace("<", "<atom:").replace("<atom:/atom:", "</atom:")
    row = normalise(parsed(spark, prefixed)).first()
    assert (row.title, row.url, row.summary) == ("T1", "https://at.example/1", "s")
    nested = '<feed><entry><link href="https://x.example/2"/><content type="xhtml"><div><p>One &amp; <b>two</b></p></div></content></entry></feed>'
    row = normalise(parsed(spark, nested)).first()
    assert (row.url, row.summary) == ("https://x.example/2", "One &amp; two")


def test_feeds_without_entries(spark):
    docs = spark.createDataFrame(list(enumerate([A, C, PARTIAL, "", None])), "i int, body string")
    assert sorted(r.i for r in feeds.feeds_without_entries(docs, "i").collect()) == [1, 3, 4]


def test_atom(spark):
    row = normalise(parsed(spark, ATOM)).first()
    assert (row.title, row.url, row.summary) == ("T1", "https://at.example/1", "s")
    assert row.published_at == datetime(2025, 5, 9, 8)


def test_permalink_id_is_the_link_of_last_resort(spark):
    item = "<rss><item><guid{}>https://g.example/1</guid></item></rss>"
    rows = parsed(spark, item.format(""), item.format(' isPermaLink="false"')).orderBy("source_id")
    assert [r.link for r in rows.collect()] == ["https://g.example/1", None]


def test_text_between_cdata_marks_may_hold_an_end_tag(spark):
    body = "<rss><item><link>https://x.example/1</link><description><![CDATA[{}]]></description></item></rss>"
    texts = ["a </item> b", "a[1]] > ]b]", "]", ""]
    rows = parsed(spark, *(body.format(t) for t in texts)).orderBy("source_id").collect()
    assert [r.description for r in rows] == texts


def test_title_default_only_when_absent(spark):
    bodies = [f"<rss><item>{t}<link>https://x.example/1</link></item></rss>" for t in ("", "<title/>", "<title> </title>")]
    rows = normalise(parsed(spark, *bodies)).orderBy("source_id").collect()
    assert [r.title for r in rows] == ["No title", "", ""]


def test_summary_before_description(spark):
    body = "<rss><item><link>https://x.example/1</link><summary>{}</summary><description>d</description></item></rss>"
    rows = normalise(parsed(spark, body.format("s"), body.format(""))).orderBy("source_id").collect()
    assert [r.summary for r in rows] == ["s", "d"]


def test_cap_counts_entries_without_link(spark):
    body = "<rss><item><title>x</title></item><item><link>https://x.example/1</link></item></rss>"
    assert normalise(feed_cap(parsed(spark, body), 1)).count() == 0
    assert normalise(parsed(spark, body, first=1)).count() == 0
    assert normalise(parsed(spark, body, first=2)).count() == 1


def test_repository_responses(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"path":"a/b","status":200,"body":"{\\"full_name\\":\\"a/b\\",\\"stargazers_count\\":5,\\"topics\\":[\\"t\\"]}"}\n'
        '{"path":"c/d","status":404,"body":"{}"}\n{"path":"e/f","status":200,"body":"oops"}\n'
    )
    rows = repos.read_repos(spark, str(tmp_path)).collect()
    assert [(r.full_name, r.stargazers_count, r.topics, r.description) for r in rows] == [("a/b", 5, ["t"], None)]


def test_search_responses(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"items":[{"full_name":"a/b"},{"full_name":"c/d"}]}\n{"total":0}\n{"items":[]}\n')
    assert [r.full_name for r in repos.read_search(spark, str(tmp_path)).collect()] == ["a/b", "c/d"]


def test_pages_and_listings(spark, tmp_path):
    from quillcast.sources import pages

    spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "page_id int, body string").write.parquet(str(tmp_path / "p"))
    assert [r.page_id for r in pages.read_pages(spark, str(tmp_path / "p")).collect()] == [1]
    (tmp_path / "l.json").write_text('{"page_no":1,"status":200,"html":"x"}\n{"page_no":2,"status":500,"html":"y"}\n')
    assert [r.page_no for r in pages.read_listing(spark, str(tmp_path / "l.json")).collect()] == [1]


def test_all_entities_of_html(spark):
    item = "<item><title>{}</title><link>https://x.example/1</link></item>"
    cases = {
        "&Uuml;ber &rarr; &alpha;&Omega; &nbsp;&amp;": "Über → αΩ \xa0&",
        "&uuml&Uuml; &nosuch; & &;": "&uumlÜ &nosuch; & &;",
        "&euro;&euro;<![CDATA[&euro;]]>&lt;b&gt;": "€€&euro;<b>",
        "no entity": "no entity",
    }
    body = "<rss>" + "".join(item.format(t) for t in cases) + "</rss>"
    got = [r.title for r in parsed(spark, body).orderBy("position").collect()]
    assert got == list(cases.values())


def test_any_prefix_of_entries(spark):
    atom = "http://www.w3.org/2005/Atom"
    entry = '<{0}entry><{0}title>T</{0}title><{0}link href="https://x.example/1"/></{0}entry>'
    bodies = [f'<{p}:feed xmlns:{p}="{atom}">' + entry.format(f"{p}:") + f"</{p}:feed>" for p in ("a", "atom", "n-1.x")]
    bodies.append(f"<x:feed xmlns:x = '{atom}' xmlns:media='m'>" + entry.format("x:") * 2 + "</x:feed>")
    bodies.append(f'<feed xmlns="{atom}" xmlns:b="other">' + entry.format("") + "<b:entry>no</b:entry></feed>")
    got = sorted((r.source_id, r.position, r.title, r.link) for r in parsed(spark, *bodies).collect())
    assert got == [(s, p, "T", "https://x.example/1") for s, p in ((0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (4, 0))]


def test_published_time_is_none_other(spark):
    dates = "<updated>2025-05-09T08:00:00Z</updated><date>2025-05-09T08:00:00Z</date>"
    item = "<entry><title>t</title><link href='https://x.example/1'/>{}</entry>"
    got = parsed(spark, item.format(dates), item.format(dates + "<published>2024-01-01T00:00:00Z</published>"))
    assert [r.published for r in got.orderBy("source_id").collect()] == ["", "2024-01-01T00:00:00Z"]


def dump(n):
    items = [
        f"<item><title>T{i} &mdash; <![CDATA[<b>]]></title>\n<link>https://x.example/{i}?a=1&b=2</link></item>\n"
        for i in range(n)
    ]
    items[n // 2] = "<item><title>broken <b </title></item>"
    return "<rss><channel><title>t</title>" + "".join(items) + "</channel></rss>"


def test_dumps_are_read_in_parts(spark, tmp_path, conf):
    """The rows of whole files, in several tasks; a broken record is lost alone."""
    (tmp_path / "big.xml").write_text(dump(3000))
    (tmp_path / "small.xml").write_text(dump(3))
    (tmp_path / "none.xml").write_text("<rss><channel></channel></rss>")
    whole = feeds.read_feeds(spark, str(tmp_path)).orderBy("path", "position").collect()
    conf("spark.sql.files.maxPartitionBytes", "20k")
    conf("spark.sql.files.openCostInBytes", "1k")
    found = feeds.read_feed_dump(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 8
    rows = found.orderBy("path", "position").collect()
    fields = lambda r: (r.path, r.link, r.title, r.summary, r.description, r.published)
    assert [fields(r) for r in rows] == [fields(r) for r in whole]
    assert len(rows) == 2999 + 2 and len({(r.path, r.position) for r in rows}) == len(rows)


def test_dumps_with_a_prefix(spark, tmp_path):
    entry = '<a:entry><a:title>T{0}</a:title><a:link href="https://x.example/{0}"/></a:entry>\n'
    body = '<a:feed xmlns:a="http://www.w3.org/2005/Atom">' + "".join(map(entry.format, range(5))) + "</a:feed>"
    (tmp_path / "a.xml").write_text(body)
    got = feeds.read_feed_dump(spark, str(tmp_path), "a:entry").orderBy("position").collect()
    assert [(r.position, r.title, r.link) for r in got] == [(i, f"T{i}", f"https://x.example/{i}") for i in range(5)]
