"""The seen-set as a stream against one pass over all marks, and hot keys alone copied."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from quillcast.operators import seen_set, skew
from quillcast.sources import folders, kept
from quillcast.streaming import seen, streams

DAY0 = datetime(2025, 1, 1)
MARK = "tenant int, url_hash string, marked_at timestamp_ntz"


def at(minutes):
    return DAY0 + timedelta(minutes=minutes)


def plain_live(rows, asof, ttl):
    """Live keys by set, by one pass over the sorted marks."""
    sets = {}
    for tenant, key, minute in sorted(rows, key=lambda r: r[2]):
        live, last = sets.get(tenant, (set(), None))
        sets[tenant] = ({key} if last is None or minute - last >= ttl else live | {key}), minute
    return {(t, k) for t, (live, last) in sets.items() if last + ttl > asof for k in live}


def plain_lives(rows, ttl):
    """Every life of every set: first and last mark, end, number of marks."""
    lives = {}
    for tenant, _, minute in sorted(rows, key=lambda r: r[2]):
        of_set = lives.setdefault(tenant, [])
        if of_set and minute - of_set[-1][1] < ttl:
            of_set[-1] = (of_set[-1][0], minute, minute + ttl, of_set[-1][3] + 1)
        else:
            of_set.append((minute, minute, minute + ttl, 1))
    return {(t, at(a), at(b), at(c), n) for t, of_set in lives.items() for a, b, c, n in of_set}


def land(spark, rows, path):
    made = [(t, k, at(m)) for t, k, m in rows]
    spark.createDataFrame(made, MARK).coalesce(1).write.mode("append").parquet(path)


def marks(n, seed, tenants=12, span=20_000):
    rnd = random.Random(seed)
    return [(0 if i % 3 == 0 else rnd.randrange(tenants), f"k{rnd.randrange(60)}", rnd.randrange(span)) for i in range(n)]


def run(spark, landing, root, **args):
    stream = streams.landed(spark, landing, MARK, 1)
    kept_set = seen.SeenSet(spark, root, "tenant int", "400 minutes", buckets=4, **args)
    seen.seen_stream(stream, kept_set).awaitTermination()
    return kept_set


def live(kept_set, minutes):
    return {(r.tenant, r.url_hash) for r in kept_set.live(at(minutes)).collect()}


def test_batches_in_order_equal_one_pass(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept.KeptLog.fold, "__defaults__", (3,))
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = sorted(marks(600, 1), key=lambda r: r[2])
    for i in range(0, len(rows), 100):
        land(spark, rows[i : i + 100], landing)
        so_far = rows[: i + 100]
        found = run(spark, landing, root)
        now = so_far[-1][2]
        assert live(found, now) == plain_live(so_far, now, 400)
        assert live(found, now + 300) == plain_live(so_far, now + 300, 400)
        batch = seen_set.seen_set_live(
            spark.createDataFrame([(t, k, at(m)) for t, k, m in so_far], MARK), at(now), "400 minutes", ["tenant"]
        )
        assert live(found, now) == {(r.tenant, r.url_hash) for r in batch.collect()}
    assert live(found, now + 400) == set()


def test_late_marks_join_lives_again(spark, tmp_path):
    """Marks up to 1000 minutes late, in any order: equal to one pass; later ones are left out."""
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")
    rnd = random.Random(4)
    rows = sorted(marks(400, 2, span=8000), key=lambda r: r[2] + rnd.randrange(900))
    for i in range(0, len(rows), 80):
        land(spark, rows[i : i + 80], landing)
    found = run(spark, landing, root, late="1000 minutes")
    now = max(r[2] for r in rows)
    assert live(found, now) == plain_live(rows, now, 400)
    land(spark, [(1, "late", now - 1200), (2, "in time", now - 100)], landing)
    found = run(spark, landing, root, late="1000 minutes")
    got = {k for _, k in live(found, now)}
    assert "late" not in got and "in time" in got


def test_state_ends_after_a_silence(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept.KeptLog.fold, "__defaults__", (1,))
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, [(t, f"k{k}", t) for t in range(5) for k in range(20)], landing)
    found = run(spark, landing, root)
    assert found.lives().count() == 5 and found.keys.read().count() == 100
    for i in range(1, 6):
        land(spark, [(0, "a", 500 * i)], landing)
        found = run(spark, landing, root)
    assert [(r.tenant, r.first) for r in found.lives().collect()] == [(0, at(2500))]
    assert [(r.tenant, r.url_hash) for r in found.keys.read().collect()] == [(0, "a")]
    assert len(folders.names(spark, f"{root}/lives")) == 2


def test_a_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept.KeptLog.fold, "__defaults__", (2,))
    landing, root = tmp_path / "in", tmp_path / "out"
    rows = sorted(marks(300, 3), key=lambda r: r[2])
    for i in range(0, 300, 100):
        land(spark, rows[i : i + 100], str(landing))
    found = run(spark, str(landing), str(root))
    now = rows[-1][2]
    before = live(found, now)
    assert before == plain_live(rows, now, 400)
    commits = root / "checkpoint/commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).rename(tmp_path / f"moved{name}")
    found = run(spark, str(landing), str(root))
    assert live(found, now) == before


def test_one_set_without_a_name(spark, tmp_path):
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, [(1, "a", 0), (1, "b", 300), (1, "c", 800)], landing)
    found = seen.SeenSet(spark, root, "", "400 minutes", buckets=2)
    assert found.live(at(0)).isEmpty()
    seen.seen_stream(streams.landed(spark, landing, MARK), found).awaitTermination()
    assert [r.url_hash for r in found.live(at(800)).collect()] == ["c"]


@pytest.mark.parametrize("by", [["tenant"], []])
def test_ended_lives(spark, tmp_path, by):
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = sorted(marks(300, 6, tenants=5 if by else 1), key=lambda r: r[2])
    rows += [(9, "end", 40_000), (9, "end", 40_001)]
    for i in range(0, len(rows), 100):
        land(spark, rows[i : i + 100], landing)
    land(spark, [(9, "end", 40_001)], landing)  # the watermark of a batch counts from the next one on
    rows.append((9, "end", 40_001))
    lives = seen.lives_stream(streams.landed(spark, landing, MARK, 1), "400 minutes", by)
    out = streams.write_available(lives, root)
    got = {(r.tenant if by else 0, r.first_mark, r.last_mark, r.emptied_at, r.n_marks) for r in out.collect()}
    want = plain_lives(rows if by else [(0, k, m) for _, k, m in rows], 400)
    assert got == {x for x in want if x[2] < at(40_000)}


def skewed(spark, hot):
    group = F.when((F.col("id") % 3 == 0) & F.lit(hot), 0).otherwise(F.col("id") % 3000)
    return spark.range(30_000).select(group.alias("g"), F.lit("x").alias("h"), "id")


@pytest.mark.parametrize("hot", [True, False])
def test_only_hot_keys_are_copied(spark, hot):
    rows = skewed(spark, hot)
    found = rows.select(skew.hot_keys(rows, ["g", "h"]).alias("hot")).first().hot
    assert len(found) == (1 if hot else 0)
    per_key = spark.range(3000).select(F.col("id").alias("g"), F.lit("x").alias("h"), (F.col("id") * 2).alias("v"))
    joined = skew.join_one(rows, per_key, ["g", "h"], ["id"])
    assert joined.count() == 30_000 and joined.where("v != 2 * g").isEmpty()
    joined.collect()
    copies = spark.createDataFrame([], "n long")  # rows that the join's other side came to
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in text and copies.isEmpty()
    is_hot = F.array_contains(skew.hot_keys(rows, ["g", "h"]), F.xxhash64("g", "h"))
    assert per_key.where(is_hot).count() == len(found)


def test_hot_keys_of_nothing(spark):
    rows = spark.range(0).select(F.col("id").alias("g"))
    per_key = spark.range(3).select(F.col("id").alias("g"))
    assert skew.join_one(rows.withColumn("i", F.lit(1)), per_key, ["g"], ["i"]).count() == 0
