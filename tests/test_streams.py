"""Feed files to ledger and messages, counts that end, and numbering without one task for all."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from quillcast import schemas
from quillcast.operators import compose, registry
from quillcast.sources import folders, tables
from quillcast.streaming import streams
from test_jobs import ASOF, inputs, land

SOURCE = "source_id bigint, digest_id bigint, name string, url string, type string, active boolean"
ITEM = "<item><title>T {0}</title><link>https://x.example/{0}</link>\n<description>Text {0}.</description></item>\n"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def url_folder(url):
    return hashlib.sha256(url.encode()).hexdigest()


def feed(landing, folder, name, links):
    (landing / folder).mkdir(parents=True, exist_ok=True)
    items = "".join(map(ITEM.format, links))
    (landing / folder / name).write_text(f"<rss><channel>\n{items}</channel></rss>")


def replayed(root, tmp_path, n):
    """Forget that the last batch was done, as after a crash before its commit."""
    commits = root / "checkpoint/commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).rename(tmp_path / f"{n}{name}")


def messages(spark, root):
    found = spark.read.schema(schemas.MESSAGES).parquet(f"{root}/messages").collect()
    return sorted((r.run, r.digest_id, r.chunk_no, r.chunk) for r in found)


def test_feed_files_to_ledger_and_messages(spark, tmp_path):
    landing, root = tmp_path / "in", tmp_path / "root"
    kept = str(tmp_path / "registry")
    rows = [(1, 1, "One", "https://one.example/feed", "rss", True), (2, 1, "Off", "https://off.example/feed", "rss", False)]
    spark.createDataFrame(rows, SOURCE).write.parquet(kept)

    def run():
        entries = streams.landed_feeds(spark, str(landing), files_per_batch=1)
        read = lambda session: session.read.schema(SOURCE).parquet(kept)
        streams.digest_stream(entries, read, str(root), ASOF).awaitTermination()
        ledger = tables.ledger_of(spark, str(root)).read().collect()
        return sorted((r.source_id, r.title) for r in ledger)

    feed(landing, url_folder("https://one.example/feed"), "a.xml", range(15))
    feed(landing, f"feed={url_folder('https://off.example/feed')}", "a.xml", [100])
    feed(landing, "nobody", "a.xml", [200])
    first = sorted((1, f"T {i}") for i in range(10))
    assert run() == first
    sent = messages(spark, root)
    assert len({m[0] for m in sent}) == 1
    text = sent[0][3]
    assert "10 articles from 1 sources" in text and [text.index(f"T {i}*") for i in range(10)] == sorted(
        text.index(f"T {i}*") for i in range(10)
    )

    # a replay of the last batch changes nothing
    replayed(root, tmp_path, 1)
    assert run() == first and messages(spark, root) == sent

    # the registry is read again: a source switched on counts for files from now on
    switched = [(*r[:5], True) for r in rows]
    spark.createDataFrame(switched, SOURCE).write.mode("overwrite").parquet(kept)
    feed(landing, url_folder("https://off.example/feed"), "b.xml", [101, 3])
    assert run() == sorted([*first, (2, "T 101")])
    again = messages(spark, root)
    assert [m for m in again if m in sent] == sent and len({m[0] for m in again}) == 2
    replayed(root, tmp_path, 2)
    assert run() == sorted([*first, (2, "T 101")]) and messages(spark, root) == again


def test_a_replay_from_before_the_ledger_was_written(spark, tmp_path):
    """Articles and messages were written, the ledger wasn't: the replay writes it, and the same messages."""
    root, landing = tmp_path / "root", str(tmp_path / "in")
    sources, _, _ = inputs(spark)
    land(spark, [(1, p, f"u{p}", f"t{p}", "s " * 900, "", None) for p in range(9)], landing)

    def run():
        streams.digest_stream(streams.landed(spark, landing, schemas.ENTRIES), sources, str(root), ASOF).awaitTermination()

    run()
    sent = messages(spark, root)
    assert [m[2] for m in sent if m[1] == 1] == list(range(sum(m[1] == 1 for m in sent)))
    replayed(root, tmp_path, 1)
    folders.delete(spark, f"{root}/ledger")
    run()
    assert messages(spark, root) == sent
    assert tables.ledger_of(spark, str(root)).read().count() == 9


def test_long_digests_are_chunks_in_order(spark, tmp_path):
    root, landing = tmp_path / "root", str(tmp_path / "in")
    sources, _, _ = inputs(spark)
    long = lambda s, p: " ".join(f"w{s}x{p}x{i}" for i in range(40)) + "."
    rows = [(s, p, f"u{s}-{p}", long(s, p), long(p, s), "", None) for s in (1, 10, 11) for p in range(10)]
    land(spark, rows, landing)
    streams.digest_stream(streams.landed(spark, landing, schemas.ENTRIES), sources, str(root), ASOF).awaitTermination()
    path = next((root / "messages").glob("digest_date=*/run=*/part-*.parquet"))
    rows = spark.read.parquet(str(path)).collect()  # in the order of the file
    assert [r.chunk_no for r in rows] == list(range(len(rows))) and len(rows) > 2
    assert all(len(r.chunk) <= 4096 for r in rows)


def test_counts_of_days_end(spark, tmp_path):
    """State of days that are over is dropped, late rows beyond the watermark are left out."""
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")
    kept = []
    for day in range(12):
        rows = [(ASOF + timedelta(days=day, minutes=i),) for i in range(day + 1)]
        rows += [(ASOF - timedelta(days=30),)] if day == 9 else []  # too late
        rows += [(ASOF + timedelta(days=day - 1),)] if day else []  # late, in time
        spark.createDataFrame(rows, "sent_at timestamp_ntz").coalesce(1).write.mode("append").parquet(landing)
        ledger = streams.landed(spark, landing, "sent_at timestamp_ntz")
        query = streams.upsert_day_counts(streams.sent_per_day_stream(ledger), root)
        query.awaitTermination()
        kept.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
    got = {r.sent_date: r.n_sent for r in streams.read_day_counts(spark, root).collect()}
    want = {(ASOF + timedelta(days=d)).date(): d + 1 + (d < 11) for d in range(12)}
    assert got == want
    assert max(kept) <= 4


def test_batches_write_only_the_days_they_change(spark, tmp_path):
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")
    for day in (0, 1, 2):
        rows = [(ASOF + timedelta(days=day),)]
        spark.createDataFrame(rows, "sent_at timestamp_ntz").coalesce(1).write.mode("append").parquet(landing)
    counts = streams.sent_per_day_stream(streams.landed(spark, landing, "sent_at timestamp_ntz", 1))
    streams.upsert_day_counts(counts, root).awaitTermination()
    parts = [n for n in folders.names(spark, f"{root}/counts/parts")]
    sizes = [spark.read.parquet(f"{root}/counts/parts/{n}").count() for n in parts]
    assert sum(sizes) == 3 and max(sizes) == 1


@pytest.mark.parametrize("sparse", [True, False])
def test_numbering_has_no_single_task_for_all(spark, tmp_path, conf, sparse):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a few rows are one range
    rng = random.Random(3)
    seqs = list({rng.randrange(-(2**62), 2**62) for _ in range(5000)}) if sparse else list(range(7, 5007))
    rng.shuffle(seqs)
    rows = spark.createDataFrame([(s,) for s in seqs], "seq bigint").repartition(8)
    found = registry.dense_number(rows, "seq", "n", str(tmp_path))
    assert [r.n for r in found.orderBy("seq").collect()] == list(range(1, len(seqs) + 1))
    text = plan(found)
    # only the sizes of ranges meet in one task
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            assert any("_size" in below for below in lines[i : i + 2]) and "seq" not in line
    counts = spark.read.parquet(f"{tmp_path}/ranges").groupBy("_part").count().collect()
    assert len(counts) > 4 and max(r["count"] for r in counts) < 2000


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_header_has_the_readers_date(spark, conf, zone):
    """On an evening in Toronto it is the next day in UTC; the session's zone doesn't matter."""
    conf("spark.sql.session.timeZone", zone)
    new = spark.createDataFrame([(1,)], "digest_id bigint")
    sources = spark.createDataFrame([(1, True)], "digest_id bigint, active boolean")
    evening = datetime(2025, 5, 10, 1, 30)
    of = lambda *args: compose.digest_header(new, sources, evening, *args).first().header
    assert "Friday, May 9 2025" in of() and "Saturday, May 10 2025" in of("UTC")
    assert of().startswith("📰 *Your Daily AI & Tech Digest*\n_Friday, May 9 2025, 1 articles from 1 sources_\n")
    article = spark.createDataFrame(
        [(1, 1, 0, "t", "https://x.example/1", "S")],
        "digest_id bigint, source_id bigint, position bigint, title string, url string, source_name string",
    )
    assert "_Friday, May 9 2025_" in compose.linked_headlines(article, evening).first().text
