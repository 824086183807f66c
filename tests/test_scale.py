"""Plans and skew: what must hold when one key has a third of all rows."""

import random
import re
from datetime import datetime, timedelta

import pytest
from checks.catalog import QUERIES, Inputs
from conftest import SF_DIR
from pyspark.sql import functions as F
from quillcast.operators import caps, novelty, seen_set, trending

DAY0 = datetime(2025, 1, 1)
STREAMED = {name for name in QUERIES if name.startswith("stream_")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMED))
def test_no_products_and_no_python(spark, name):
    """No query joins without a key or leaves the JVM."""
    text = plan(QUERIES[name](spark, SF_DIR))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas", text)


def test_caps_limit_groups_before_the_shuffle(spark):
    t = Inputs(spark, SF_DIR)
    for df in (caps.feed_cap(t.fx_entries), trending.repo_candidates(t.paths()), t.capped()):
        below = re.findall(r", Final\n[^\n]*Sort[^\n]*\n[^\n]*Exchange[^\n]*\n([^\n]*)", plan(df))
        assert below and all("Partial" in line for line in below)


def test_scans_read_needed_columns_only(spark):
    t = Inputs(spark, SF_DIR)
    text = plan(t.pages.select("page_id", F.sha2("url", 256)))
    assert "html" not in text
    keys = plan(novelty.sent_hashes(t.articles(), t.fx_ledger))
    assert "description" not in keys


def test_filters_reach_the_scan(spark, tmp_path):
    from quillcast import schemas
    from quillcast.operators import reports
    from quillcast.sources import tables

    path = str(tmp_path / "ledger")
    rows = [(f"h{i}", "t", 1, DAY0 + timedelta(hours=i)) for i in range(100)]
    df = spark.createDataFrame(rows, "url_hash string, title string, source_id bigint, sent_at timestamp_ntz")
    tables.write_daily_ledger(df.withColumn("sent_date", F.to_date("sent_at")), path)
    ledger = tables.read_daily_ledger(spark, path)
    assert ledger.columns == [f.split()[0] for f in schemas.LEDGER.split(", ")]
    today = reports.count_sent_today(ledger, DAY0 + timedelta(days=2, hours=5))
    assert "PartitionFilters: [isnotnull(sent_date" in plan(today)
    assert today.first()[0] == 48 + 4


def skewed(spark, n=30_000, groups=300):
    """Rows of which group 0 has a third."""
    group = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % groups)
    return spark.range(n).select(group.cast("bigint").alias("g"), F.xxhash64("id").alias("v"), "id")


def test_hot_source_cap(spark):
    entries = skewed(spark).select(F.col("g").alias("source_id"), F.col("id").alias("position"))
    got = caps.feed_cap(entries, 10).collect()
    want = {}
    for r in entries.orderBy("position").collect():
        want.setdefault(r.source_id, []).append(r.position)
    assert {(r.source_id, r.position) for r in got} == {(s, p) for s, ps in want.items() for p in ps[:10]}


def test_feed_cap_of_some_sources(spark):
    """Positions that several documents share don't exceed the cap; planning runs no job."""
    entries = skewed(spark).select(
        F.col("g").alias("source_id"), (F.col("v") % 20).alias("position"), F.col("id").cast("string").alias("link")
    )
    for ids in ([0, 1, 2, 3, 999], [5, 6], []):
        sources = spark.createDataFrame([(i,) for i in ids], "source_id bigint")
        spark.sparkContext.setJobGroup(f"cap{len(ids)}", "plan")
        capped = caps.feed_cap_of(entries, sources, 10)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"cap{len(ids)}")
        rows = sorted((r.source_id, r.position, r.link) for r in entries.collect() if r.source_id in ids)
        want = [r for i in ids for r in [x for x in rows if x[0] == i][:10]]
        assert sorted((r.source_id, r.position, r.link) for r in capped.collect()) == sorted(want)


def largest_share(df):
    """Largest share of the rows that one task has."""
    sizes = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    return max(sizes) / sum(sizes)


def test_hot_digest_overflow_is_spread(spark, conf):
    """Without any broadcast or run-time help the hot digest is spread, and no row is lost."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    new = skewed(spark, groups=3).select(
        F.col("g").alias("digest_id"), (F.col("v") % 50).alias("source_id"), F.col("id").alias("position")
    )
    rest = caps.digest_overflow(new, 30)
    assert rest.count() == new.count() - caps.digest_cap(new, 30).count()
    assert largest_share(rest) < 0.2


def test_hot_new_url_is_spread(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    new = skewed(spark, groups=3).select(
        F.sha2(F.col("g").cast("string"), 256).alias("url_hash"), F.col("id").alias("position"), F.lit(1).alias("source_id")
    )
    ledger = spark.range(2, 100).select(F.sha2(F.col("id").cast("string"), 256).alias("url_hash"))
    rest = novelty.anti_ledger(new, ledger)
    assert rest.count() == 20_000
    assert largest_share(rest) < 0.2


def test_hot_url_is_reduced_before_the_lookup(spark):
    new = skewed(spark).select(
        F.sha2(F.col("g").cast("string"), 256).alias("url_hash"), F.col("id").alias("position"), F.lit(1).alias("source_id"),
        F.lit("t").alias("title"),
    )
    ledger = spark.range(0, 300, 2).select(F.sha2(F.col("id").cast("string"), 256).alias("url_hash"))
    got = novelty.anti_ledger(new, ledger)
    want = new.join(ledger, "url_hash", "left_anti")
    assert got.select("position").exceptAll(want.select("position")).isEmpty() and got.count() == want.count()
    assert novelty.ledger_append(new, ledger, DAY0).count() == want.select("url_hash").distinct().count()


def test_hot_tenant_set(spark):
    """One tenant with a third of the marks, against one pass over its sorted marks."""
    rnd = random.Random(5)
    rows = [(0 if i % 3 == 0 else i % 40, f"k{i % 97}", DAY0 + timedelta(minutes=rnd.randint(0, 20_000))) for i in range(6000)]
    asof, ttl = DAY0 + timedelta(minutes=20_000), timedelta(minutes=400)
    want = set()
    for tenant in range(40):
        live, last = set(), None
        for m, k in sorted((m, k) for t, k, m in rows if t == tenant):
            live = {k} if last is None or m - last >= ttl else live | {k}
            last = m
        if last is not None and last + ttl > asof:
            want |= {(tenant, k) for k in live}
    df = spark.createDataFrame(rows, "tenant int, url_hash string, marked_at timestamp_ntz")
    got = seen_set.seen_set_live(df, asof, "400 minutes", ["tenant"]).collect()
    assert {(r.tenant, r.url_hash) for r in got} == want
