"""Result reuse against brute force, hot keys included."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import cache, engine
from wardline.operators.joins import is_small, join_back, lookup_join
from wardline.session import scratch_dir, written_tables
from wardline.sources import sinks
from tests.plans import plan


@pytest.fixture(scope="module")
def texts(spark):
    """300 texts, a third of them the same."""
    rng = random.Random(1)
    rows = [(i, "the same idiot" if i % 3 == 0 else f"text {rng.randrange(60)} good") for i in range(300)]
    return spark.createDataFrame(rows, "id long, text string").withColumn("cache_key", F.md5("text"))


def score(df):
    return engine.validate(df, "strict").select(*df.columns, "valid")


def plain_answers(texts):
    return {r["id"]: r["valid"] for r in score(texts).collect()}


def first_of_text(texts):
    seen, hits = set(), {}
    for r in sorted(texts.collect()):
        hits[r["id"]] = r["text"] in seen
        seen.add(r["text"])
    return hits


@pytest.mark.parametrize("hot_rows", [None, 10, 1_000_000])
def test_score_once(texts, hot_rows):
    out = cache.score_once(texts, score, "id", hot_rows=hot_rows).collect()
    assert {r["id"]: r["valid"] for r in out} == plain_answers(texts) and len(out) == 300
    assert {r["id"]: r["cache_hit"] for r in out} == first_of_text(texts)


def test_copies_are_hits(texts):
    out = cache.with_cache_hit(texts, "id").collect()
    assert {r["id"]: r["cache_hit"] for r in out} == first_of_text(texts)


@pytest.mark.parametrize("hot_rows", [None, 10])
def test_through_store(texts, hot_rows):
    known = texts.where("id < 30").select("cache_key", "text").distinct()
    live = score(known).select("cache_key", "valid")
    asking = texts.withColumn("skip", F.col("id") % 7 == 0)
    out = cache.validate_through_store(asking, live, score, "id", bypass="skip", hot_rows=hot_rows).collect()
    assert {r["id"]: r["valid"] for r in out} == plain_answers(texts) and len(out) == 300
    stored = {r["cache_key"] for r in known.collect()}
    seen = set()
    for r in sorted(out, key=lambda r: r["id"]):
        if r["id"] % 7 == 0:  # past the store
            assert not r["cache_hit"]
            continue
        assert r["cache_hit"] == (r["cache_key"] in stored or r["cache_key"] in seen)
        seen.add(r["cache_key"])


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_through_a_bucketed_store(spark, texts, hot_rows):
    known = texts.where("id < 30").select("cache_key", "text").distinct()
    entries = cache.store_entries(score(known).select("cache_key", "valid"), F.timestamp_seconds(F.lit(100)), 60)
    older = entries.withColumn("valid", ~F.col("valid")).withColumn("written_at", F.timestamp_seconds(F.lit(50)))
    name = f"probed_{hot_rows}"
    store = sinks.write_bucketed_store(entries.unionByName(older), name, scratch_dir(spark, name), buckets=4)
    assert store.count() == known.count()  # the newest entry of a key
    live = store.select("cache_key", "valid")
    out = cache.validate_through_store(texts, live, score, "id", hot_rows=hot_rows, bucketed=True).collect()
    assert {r["id"]: r["valid"] for r in out} == plain_answers(texts) and len(out) == 300
    spark.sql(f"DROP TABLE {name}")


def test_a_bucketed_store_is_not_shuffled(spark, texts):
    entries = score(texts).select("cache_key", "valid").withColumn("written_at", F.timestamp_seconds(F.lit(0)))
    store = sinks.write_bucketed_store(entries, "still", scratch_dir(spark, "still"), buckets=4)
    keep, before = written_tables(spark, "still-asked"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(cache.store_join(texts.select("id", "cache_key"), store.select("cache_key", "valid"), "cache_key", keep))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("Exchange") == 1 and "Bucketed: true" in text
    spark.sql("DROP TABLE still")


def test_misses_are_scored_once(texts):
    asked = []

    def counting(df):
        asked.append(df.count())
        return score(df)

    live = score(texts.where("id < 30").select("cache_key", "text").distinct()).select("cache_key", "valid")
    cache.validate_through_store(texts, live, counting, "id").collect()
    missing = texts.join(live, "cache_key", "left_anti").select("text").distinct().count()
    assert asked == [missing]


def test_probe(texts):
    live = texts.where("id < 30").select("cache_key").distinct()
    stored = {r["cache_key"] for r in live.collect()}
    for r in cache.probe(texts, live, "id", hot_rows=10).collect():
        assert r["outcome"] == ("hit" if r["cache_key"] in stored else "miss")


def test_key_depends_on_policy_and_version(spark):
    df = spark.createDataFrame([("t", "strict", "1"), ("t", "strict", "2"), ("t", "default", "1"), ("t", "strict", "1")],
                               "text string, g string, v string")
    keys = [r[0] for r in df.select(cache.cache_key(F.col("text"), F.col("g"), F.col("v"))).collect()]
    assert len(set(keys)) == 3 and keys[0] == keys[3]


def log_rows(seed):
    """A log in which one key has most of the traffic, with bursts and pauses."""
    rng, rows, at = random.Random(seed), [], 0
    for i in range(600):
        at += rng.choice([0, 1_000, 300_000, 2_000_000, 40_000_000, 700_000_000])
        rows.append((i, rng.choice(["hot", "hot", "hot", f"k{rng.randrange(5)}"]), at))
    return rows


@pytest.fixture(scope="module", params=[1, 2, 3])
def log(request, spark):
    rows = log_rows(request.param)
    frame = spark.createDataFrame(rows, "event_id long, key string, at long").withColumn(
        "ts", F.timestamp_micros("at"))
    return rows, frame


@pytest.mark.parametrize("ttl", [1, 60, 300])
def test_replay_with_refreshing_entries(log, ttl):
    rows, frame = log
    last, hits, misses = {}, {}, set()
    for event, key, at in rows:
        if key in last and at - last[key] <= ttl * 1_000_000:
            hits[key] = hits.get(key, 0) + 1
        else:
            misses.add(event)
        last[key] = at
    out = cache.replay_refreshing(frame, ["key"], ttl=ttl).collect()
    got = {}
    for r in out:
        got[r["key"]] = got.get(r["key"], 0) + r["hits"]
    assert {k: v for k, v in got.items() if v} == hits
    assert {r["missing_id"] for r in out if r["missing_id"] is not None} == misses
    assert sum(r["requests"] for r in out) == len(rows)


@pytest.mark.parametrize("ttl", [1, 60, 300])
def test_exact_replay(log, ttl):
    rows, frame = log
    until, misses = {}, {}
    for _, key, at in rows:
        second = at // 1_000_000
        if key not in until or second >= until[key]:
            until[key] = second + ttl
            misses[key] = misses.get(key, 0) + 1
    out = cache.replay_exact(frame, ["key"], ttl=ttl).groupBy("key").agg(
        F.sum("misses").alias("m"), F.sum("hits").alias("h")).collect()
    assert {r["key"]: r["m"] for r in out} == misses
    assert sum(r["m"] + r["h"] for r in out) == len(rows)


@pytest.mark.parametrize("ttl", [1, 7, 60])
def test_exact_replay_of_a_key_that_never_pauses(spark, ttl):
    rng, rows, second = random.Random(9), [], 0
    while second < 3000:
        second += rng.randrange(1, max(2, ttl))
        rows += [("busy", second)] * rng.choice([1, 1, 3])
    rows += [(None, s) for s in (3, 4, 3 + ttl, 5000)]
    until, misses = {}, {}
    for key, s in sorted(rows, key=lambda r: r[1]):
        if s >= until.get(key, -1):
            until[key], misses[key] = s + ttl, misses.get(key, 0) + 1
    frame = spark.createDataFrame(rows, "key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = cache.replay_exact(frame, ["key"], ttl=ttl)
    got = {r["key"]: (r["m"], r["n"], r["runs"]) for r in out.groupBy("key").agg(
        F.sum("misses").alias("m"), F.sum("requests").alias("n"), F.count("run").alias("runs")).collect()}
    assert {k: (m, n) for k, (m, n, _) in got.items()} == {
        k: (misses[k], sum(key == k for key, _ in rows)) for k in misses}
    assert ttl == 1 or got["busy"][2] == 1


def test_replays_gather_no_lists(spark, log):
    seconds = spark.createDataFrame([(("a",), 1)], "_key struct<k:string>, sec long")
    text = plan(cache.miss_links(seconds, 60)) + plan(cache.replay_exact(log[1], ["key"]))
    assert "collect_list" not in text and "ObjectHashAggregate" not in text


@pytest.mark.parametrize("ttl, slice_seconds", [(60, 3600), (5000, 600), (300, 300)])
def test_live_hits(spark, log, ttl, slice_seconds):
    rows, frame = log
    written = frame.where("event_id % 50 = 0").select("key", "ts")
    entries = cache.store_entries(written, F.col("ts"), ttl)
    wanted = {e for e, key, at in rows for e2, key2, at2 in rows
              if e2 % 50 == 0 and key2 == key and at2 <= at < at2 + ttl * 1_000_000}
    got = [r["event_id"] for r in cache.live_hits(frame, entries, ["key"], slice_seconds=slice_seconds).collect()]
    assert set(got) == wanted and len(got) == len(wanted)


def test_live_entries_takes_the_newest(spark):
    store = spark.createDataFrame([("a", 0, 300, True), ("a", 100, 400, False), ("a", 500, 800, True), ("b", 0, 150, True)],
                                  "cache_key string, w long, e long, valid boolean").select(
        "cache_key", "valid", F.timestamp_seconds("w").alias("written_at"), F.timestamp_seconds("e").alias("expires_at"))
    live = cache.live_entries(store, F.timestamp_seconds(F.lit(200))).collect()
    assert [(r["cache_key"], r["valid"]) for r in live] == [("a", False)]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_salted_equals_broadcast(spark, how):
    left = spark.range(500).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20))
    right = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert is_small(right) and not is_small(right, max_rows=5) and not is_small(right, max_bytes=10)
    small = lookup_join(left, right, ["k"], "id", how)
    salted = lookup_join(left, right, ["k"], "id", how, max_rows=5, hot_rows=20)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, salted.select(*small.columns).collect()), key=str)


def test_join_back_spreads_only_hot_keys(texts):
    results = texts.select("cache_key").distinct().withColumn("v", F.substring("cache_key", 1, 4))
    plain = texts.join(results, "cache_key", "left").select("id", "v").collect()
    salted = join_back(texts, results, "cache_key", "id", hot_rows=10).select("id", "v").collect()
    assert sorted(plain) == sorted(salted)
