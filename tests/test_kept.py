"""The kept log, the bucketed lookup with its filter, and one ledger for job and stream."""

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from quillcast import schemas
from quillcast.operators import bloom, novelty
from quillcast.plans.digest import run_digest
from quillcast.sources import folders, tables
from quillcast.sources.kept import KeptLog
from quillcast.streaming import streams
from test_jobs import ASOF, inputs, land

ROW = "url_hash string, n bigint"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, ids):
    return spark.createDataFrame([(f"h{i}", i) for i in ids], ROW)


def keys(spark, ids):
    return rows(spark, ids).select("url_hash")


def log_of(spark, tmp_path, buckets=4, reduce=None):
    return KeptLog(spark, str(tmp_path / "log"), ROW, ["url_hash"], buckets, reduce)


def held(log):
    return sorted(r.n for r in log.read().collect())


def test_parts_are_replaced_and_folded(spark, tmp_path):
    log = log_of(spark, tmp_path)
    assert held(log) == []
    log.append("a", rows(spark, [1, 2]))
    log.append("b", rows(spark, [3]))
    log.append("a", rows(spark, [1, 4]))  # run again
    assert held(log) == [1, 3, 4]
    assert not log.fold(3) and log.fold(2)
    assert held(log) == [1, 3, 4]
    log.append("b", rows(spark, [3]))  # replayed after the fold
    log.append("c", rows(spark, [5]))
    assert held(log) == [1, 3, 4, 5]
    assert held(log_of(spark, tmp_path)) == [1, 3, 4, 5]
    view = log.view(without="c", where=F.col("n") > 1)
    assert sorted(r.n for r in view.rows().collect()) == [3, 4]


def test_a_part_that_was_not_finished_is_not_read(spark, tmp_path):
    log = log_of(spark, tmp_path)
    log.append("a", rows(spark, [1]))
    log.append("b", rows(spark, [2]))
    (tmp_path / "log/parts/b/_SUCCESS").unlink()
    assert held(log) == [1]
    log.fold(1)
    assert held(log) == [1]
    log.append("b", rows(spark, [2]))
    assert held(log) == [1, 2]


def test_files_stay_few_and_readers_keep_theirs(spark, tmp_path):
    log = log_of(spark, tmp_path)
    most = 0
    for i in range(100):
        before = log.read()
        log.append(f"part-{i:03d}", rows(spark, [i]).coalesce(1))
        if log.fold(10):
            assert before.count() == i  # from files that have been folded
        most = max(most, sum(1 for p in (tmp_path / "log").rglob("part-*.parquet")))
    assert held(log) == list(range(100))
    assert most <= 2 * 4 + 3 * 10
    assert len(folders.names(spark, f"{log.root}/manifest")) <= 2
    assert len(folders.names(spark, f"{log.root}/bases")) <= 2


def test_of_two_folds_at_once_one_gives_up(spark, tmp_path, monkeypatch):
    log, other = log_of(spark, tmp_path), log_of(spark, tmp_path)
    log.append("a", rows(spark, [1]))
    real = folders.write_new

    def first_the_other(*args):
        monkeypatch.setattr(folders, "write_new", real)
        assert other.fold(1)
        return real(*args)

    monkeypatch.setattr(folders, "write_new", first_the_other)
    assert not log.fold(1)
    assert held(log) == held(other) == [1]
    assert len(folders.names(spark, f"{log.root}/bases")) == 1


def test_a_manifest_cut_short_is_passed_over(spark, tmp_path):
    log = log_of(spark, tmp_path)
    log.append("a", rows(spark, [1]))
    log.fold(1)
    folders.write_new(spark, f"{log.root}/manifest/{2:010d}", '{"base": ')
    assert held(log) == [1]


def test_folding_may_reduce(spark, tmp_path):
    latest = lambda df: df.groupBy("url_hash").agg(F.max("n").alias("n"))
    log = log_of(spark, tmp_path, reduce=latest)
    for name, n in (("a", 1), ("b", 7), ("c", 3)):
        log.append(name, spark.createDataFrame([("h", n)], ROW))
    log.fold(2)
    assert held(log) == [7]


def test_the_base_is_not_shuffled_for_a_lookup(spark, tmp_path, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    log = log_of(spark, tmp_path)
    log.append("a", rows(spark, range(200)))
    log.fold(1)
    text = plan(novelty.base_hits(keys(spark, range(150, 300)).distinct(), log.view(), bits=None))
    lines = text.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)
    depth = lambda line: re.search(r"[A-Z]", line).start()
    above, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if re.search(r"[A-Z]", line) and depth(line) < at:
            above, at = [*above, line], depth(line)
    assert any("SortMergeJoin" in line for line in above), text
    assert not any("Exchange" in line for line in above), text
    assert "Bucketed: true" in text and "Exchange hashpartitioning" in text


@pytest.mark.parametrize("bits", [None, 7, 10, 23])
def test_lookups_are_exact_whatever_the_filter(spark, tmp_path, bits):
    log = log_of(spark, tmp_path)
    log.append("a", rows(spark, range(0, 900, 3)))
    log.fold(1)
    asked = keys(spark, range(0, 900, 2)).distinct()
    found = novelty.base_hits(asked, log.view(), bits)
    assert sorted(r.url_hash for r in found.collect()) == sorted(f"h{i}" for i in range(0, 900, 6))
    assert ("subquery" in plan(found)) == (bits is not None)


def test_the_filter_lets_few_others_through(spark):
    have, others = keys(spark, range(1000)), keys(spark, range(1000, 21_000))
    passing = lambda df, bits: df.where(bloom.may_hold(bloom.bloom_filter(have, "url_hash", bits), "url_hash", bits)).count()
    assert passing(have, 16) == 1000 and passing(have, 7) == 1000
    assert 0 < passing(others, 13) < 4000
    assert passing(others, 16) < 400
    assert passing(others, 7) > 19_000
    none = bloom.bloom_filter(have.limit(0), "url_hash", 10)
    assert others.where(bloom.may_hold(none, "url_hash", 10)).isEmpty()
    with pytest.raises(ValueError):
        bloom.bloom_filter(have, "url_hash", 40)


def test_filters_are_part_of_the_scan_stage(spark, tmp_path):
    log = log_of(spark, tmp_path)
    log.append("a", rows(spark, range(50)))
    log.fold(1)
    lines = plan(novelty.base_hits(keys(spark, [1, 2]).distinct(), log.view())).splitlines()
    text = [re.sub(r"^[\s:+*()\d-]*", "", line) for line in lines]
    # the filter is in the stage of the scan: below it are only its subquery and the scan
    above = text[: next(i for i, line in enumerate(text) if "FileScan parquet" in line)]
    assert sum("Subquery subquery" in line for line in above if not line.startswith("Filter")) == 1
    assert any(line.startswith("Filter") and "Subquery subquery" in line for line in above)


def test_job_and_stream_share_a_ledger(spark, tmp_path):
    """What one of them has sent, the other doesn't send."""
    root, landing = str(tmp_path / "root"), str(tmp_path / "in")
    sources, entries, pages = inputs(spark, 3)
    row = lambda s, p, u: (s, p, u, "t", "s", "", None)
    urls = lambda: {r.url_hash for r in tables.ledger_of(spark, root).read().collect()}

    def stream():
        found = streams.landed(spark, landing, schemas.ENTRIES)
        streams.digest_stream(found, sources, root, ASOF + timedelta(hours=1)).awaitTermination()
        return sorted(r.url for r in spark.read.schema(schemas.ARTICLES).parquet(f"{root}/articles").collect())

    run_digest(spark, sources, entries, pages, root, ASOF)
    sent = urls()
    land(spark, [row(1, 0, "https://e.example/1/0"), row(1, 1, "https://e.example/new")], landing)
    assert stream() == ["https://e.example/new"]
    assert len(urls()) == len(sent) + 1
    more = spark.createDataFrame([row(1, 0, "https://e.example/new"), row(1, 1, "https://e.example/newer")], schemas.ENTRIES)
    run_digest(spark, sources, more, pages, root, ASOF + timedelta(days=1))
    new = spark.read.parquet(f"{root}/runs/20250510T120000/new")
    assert [r.url for r in new.collect()] == ["https://e.example/newer"]


def test_a_replay_after_its_part_was_folded(spark, tmp_path, monkeypatch):
    from quillcast.sources import kept

    monkeypatch.setattr(kept.KeptLog.fold, "__defaults__", (1,))
    root, landing = str(tmp_path / "root"), str(tmp_path / "in")
    sources, _, _ = inputs(spark)
    row = lambda s, p, u: (s, p, u, "t", "s", "", None)

    def stream():
        found = streams.landed(spark, landing, schemas.ENTRIES)
        streams.digest_stream(found, sources, root, ASOF).awaitTermination()
        return sorted(r.url for r in spark.read.schema(schemas.ARTICLES).parquet(f"{root}/articles").collect())

    for i in range(3):
        land(spark, [row(1, 0, "a"), row(1, 1, f"b{i}")], landing)
        assert stream() == sorted(["a", *(f"b{j}" for j in range(i + 1))])
    commits = tmp_path / "root/checkpoint/commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).rename(tmp_path / f"moved{name}")
    assert stream() == ["a", "b0", "b1", "b2"]
    ledger = tables.ledger_of(spark, root).read()
    assert ledger.count() == 4 == ledger.select("url_hash").distinct().count()
