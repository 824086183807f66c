"""Whole runs of the digest job and of the streams."""

from datetime import datetime, timedelta

from quillcast import schemas
from quillcast.plans.digest import run_digest
from quillcast.sources import tables
from quillcast.streaming import streams

ASOF = datetime(2025, 5, 9, 12)


def inputs(spark, n=25):
    sources = spark.createDataFrame(
        [(1, 1, "One", "u1", "rss", True), (2, 1, "Two", "u2", "crawl", True), (3, 2, "Off", "u3", "rss", False),
         (4, 3, "None", "u4", "rss", True), (5, 1, "Odd", "u5", "other", True)]
        + [(10 + i, 1, f"More {i}", f"u{10 + i}", "rss", True) for i in range(4)],
        "source_id bigint, digest_id bigint, name string, url string, type string, active boolean",
    )
    rows = [
        (s, p, f"https://e.example/{s}/{p}", f"T{s} {p}", f"Text {s} {p}. More.", "", None)
        for s in (1, 3, 5, 10, 11, 12, 13) for p in range(n)
    ]
    entries = spark.createDataFrame(rows, schemas.ENTRIES)
    pages = spark.createDataFrame(
        [(2, 1, "u2", " ".join(f"[L{i}](https://l.example/{i})" for i in range(n)))], schemas.PAGES
    )
    return sources, entries, pages


def state(spark, root):
    return {
        "ledger": sorted(r.url_hash for r in tables.ledger_of(spark, root).read().collect()),
        "messages": sorted(map(tuple, spark.read.parquet(f"{root}/messages").select("digest_id", "digest_date", "run", "chunk_no", "chunk").collect())),
        "marks": sorted(r.url_hash for r in spark.read.parquet(f"{root}/marks").collect()),
    }


def test_runs(spark, tmp_path):
    root = str(tmp_path / "job")
    sources, entries, pages = inputs(spark)
    run_digest(spark, sources, entries, pages, root, ASOF)
    first = state(spark, root)
    # Six active sources of known type with ten each: all recorded, thirty shown.
    assert len(first["ledger"]) == len(set(first["ledger"])) == 60
    assert first["marks"] == first["ledger"]
    text = "\n".join(m[4] for m in first["messages"] if m[0] == 1)
    assert "60 articles from 7 sources" in text
    assert text.count("(One)".replace("(", "\\(").replace(")", "\\)")) == 10
    assert {m[0]: m[4] for m in first["messages"]}[3] == "✅ No articles fetched from any source\\."
    outcomes = {r.digest_id: r.outcome for r in spark.read.parquet(f"{root}/runs/20250509T120000/outcomes").collect()}
    assert outcomes == {1: "sent", 2: "no_sources", 3: "nothing_fetched"}

    # Repeating the run changes nothing.
    run_digest(spark, sources, entries, pages, root, ASOF)
    assert state(spark, root) == first

    # The next run has nothing new to send.
    run_digest(spark, sources, entries, pages, root, ASOF + timedelta(days=1))
    second = state(spark, root)
    assert second["ledger"] == first["ledger"]
    assert [m[4] for m in second["messages"] if m[0] == 1 and m[1].day == 10] == ["✅ No new articles since last digest\\."]

    # Long after, the marks are gone but the ledger still holds.
    run_digest(spark, sources, entries, pages, root, ASOF + timedelta(days=99))
    assert state(spark, root)["ledger"] == first["ledger"]


def test_given_bodies(spark, tmp_path):
    root = str(tmp_path / "job")
    bodies = spark.createDataFrame([(1, "My body")], "digest_id bigint, body string")
    run_digest(spark, *inputs(spark, 2), root, ASOF, bodies=bodies)
    messages = spark.read.parquet(f"{root}/messages").where("digest_id = 1").collect()
    assert len(messages) == 1 and "\n\nMy body\n\n" in messages[0].chunk


def land(spark, rows, path):
    spark.createDataFrame(rows, schemas.ENTRIES).coalesce(1).write.mode("append").parquet(path)


def test_digest_stream_with_a_replay(spark, tmp_path):
    import shutil

    sources, _, _ = inputs(spark)
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda s, p, u: (s, p, u, "t", "s", "", None)

    def run():
        entries = streams.landed(spark, landing, schemas.ENTRIES)
        streams.digest_stream(entries, sources, root, ASOF).awaitTermination()
        found = spark.read.schema(schemas.ARTICLES).parquet(f"{root}/articles")
        return sorted((r.source_id, r.url) for r in found.collect())

    land(spark, [row(1, 0, "a"), row(1, 1, "a"), row(1, 2, "b"), row(3, 0, "off")], landing)
    assert run() == [(1, "a"), (1, "a"), (1, "b")]
    land(spark, [row(1, 3, "b"), row(1, 4, "c"), row(10, 0, "a")], landing)
    assert run() == [(1, "a"), (1, "a"), (1, "b"), (1, "c")]
    assert run() == [(1, "a"), (1, "a"), (1, "b"), (1, "c")]
    ledger = tables.ledger_of(spark, root).read()
    assert ledger.count() == ledger.select("url_hash").distinct().count() == 3

    # The last batch again, as after a crash between its writes and its commit.
    commits = tmp_path / "out" / "checkpoint" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    shutil.move(commits / str(last), tmp_path / "commit")
    (commits / f".{last}.crc").rename(tmp_path / "crc")
    assert run() == [(1, "a"), (1, "a"), (1, "b"), (1, "c")]
    assert tables.ledger_of(spark, root).read().count() == 3


def test_feed_stream(spark, tmp_path):
    landing, root = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    (landing / "a.xml").write_text("<rss><item><link>https://x.example/1</link></item></rss>")
    (landing / "b.xml").write_text("<rss><item><title>cut")
    out = streams.write_available(streams.landed_feeds(spark, str(landing)), root)
    assert [(r.position, r.link) for r in out.collect()] == [(0, "https://x.example/1")]


def test_ttl_stream_lets_a_key_back_in(spark, tmp_path):
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    # The watermark of a batch counts from the next one on.
    for minutes in ([0, 1], [30], [200], [201], [202]):
        rows = [("k", ASOF + timedelta(minutes=m)) for m in minutes]
        spark.createDataFrame(rows, "key string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(landing)
        arrivals = streams.landed(spark, landing, "key string, ts timestamp_ntz")
        out = streams.write_available(streams.ttl_dedup_stream(arrivals, "key", "ts", "1 hour"), root)
        seen.append(out.count())
    assert seen[0] == seen[1] == 1 and seen[-1] == 2


def test_digest_stream_caps_documents_not_batches(spark, tmp_path):
    """Three documents of a source give the same articles in one batch and in three."""
    sources, _, _ = inputs(spark)
    landing, got = str(tmp_path / "in"), {}
    for d in range(3):
        land(spark, [(1, p, f"u{d}-{p}", "t", "s", "", None) for p in range(8 + 4 * d)], landing)
    for files in (1, 1000):
        root = str(tmp_path / f"out{files}")
        entries = streams.landed(spark, landing, schemas.ENTRIES, files)
        streams.digest_stream(entries, sources, root, ASOF).awaitTermination()
        got[files] = sorted(r.url for r in spark.read.schema(schemas.ARTICLES).parquet(f"{root}/articles").collect())
    assert got[1] == got[1000] == sorted(f"u{d}-{p}" for d in range(3) for p in range(min(8 + 4 * d, 10)))
