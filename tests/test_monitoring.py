"""Metrics, limits, alerts, traces and names against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.plans import partitionings, plan
from wardline.operators import alerts, canary, metrics, ratelimit, slices, tracing
from wardline.operators.gazetteer import candidate_runs, with_entities
from wardline.operators.quantiles import (
    approximate_quantiles, exact_quantiles, merged_quantiles, quantile_sketches, rank_errors,
)


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(5)
    groups = {"hot": np.round(rng.lognormal(0, 3, 2000), 6), "mixed": rng.normal(0, 1, 301),
              "same": np.full(50, 3.25), "one": np.array([7.0]), "zero": np.array([0.0, 0.0, -1.0, 1.0])}
    return groups


@pytest.mark.parametrize("steps", [1, 8, 1024])
def test_exact_quantiles(spark, samples, steps):
    rows = [(g, float(v)) for g, values in samples.items() for v in values] + [(None, 1.0), (None, 2.0), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["probability"]): r["quantile"]
           for r in exact_quantiles(df, ["g"], "v", [0.0, 0.5, 0.95, 0.99, 1.0], steps).collect()}
    for g, values in samples.items():
        for p in (0.0, 0.5, 0.95, 0.99, 1.0):
            assert got[g, p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
    assert got[None, 0.5] == 1.5


def test_quantiles_of_the_whole_table(spark, samples):
    df = spark.createDataFrame([(float(v),) for v in samples["hot"]], "v double")
    exact = exact_quantiles(df, [], "v", [0.9]).first()["quantile"]
    assert exact == pytest.approx(np.quantile(samples["hot"], 0.9))
    near = approximate_quantiles(df, [], "v", [0.9]).first()["quantile"]
    assert near == pytest.approx(exact, rel=0.05)


def test_quantiles_count_before_they_join(spark, samples):
    df = spark.createDataFrame([("g", float(v)) for v in samples["hot"]], "g string, v double")
    text = plan(exact_quantiles(df, ["g"], "v", [0.5]))
    joined = text[text.index("Join"):]
    assert "HashAggregate(keys=[g" in joined and "partial_count" in joined.split("Join")[-1]


def test_sketches_merge_over_windows(spark, samples):
    rows = [("a", i % 7, float(v)) for i, v in enumerate(samples["hot"])] + [("b", 0, 3.0)] * 50
    rows += [("a", 1, None), ("a", 2, float("nan")), ("a", 3, float("inf")), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, w int, v double")
    stored = quantile_sketches(df, ["g", "w"], "v", items=64)
    assert stored.count() == 8
    merged = merged_quantiles(stored, ["g"], [0.0, 0.5, 0.95, 0.99, 1.0], items=64)
    found = {(r["g"], r["probability"]): r for r in rank_errors(df, ["g"], "v", merged).collect()}
    assert len(found) == 10 and all(r["rank_error"] <= 0.05 for r in found.values())
    assert found["b", 0.99]["quantile"] == 3.0 and found["b", 0.99]["rank_error"] == 0
    assert found["a", 0.5]["n"] == 2000 and found["a", 1.0]["quantile"] == max(samples["hot"])
    off = rank_errors(df, ["g"], "v", merged.withColumn("quantile", F.lit(float(np.quantile(samples["hot"], 0.9)))))
    assert {round(r["rank_error"], 2) for r in off.where("g = 'a'").collect()} == {0.9, 0.4, 0.05, 0.09, 0.1}


def test_histogram(spark):
    df = spark.createDataFrame([("a", v) for v in (0.05, 0.1, 0.3, 99.0)] + [("a", None)], "l string, v double")
    got = {r["le"]: (r["cumulative"], r["observations"], r["total"])
           for r in metrics.histogram(df, "v", metrics.REQUEST_BUCKETS, "l").collect()}
    assert got["0.1"] == (2, 4, 99.45) and got["0.5"][0] == 3 and got["60.0"][0] == 3 and got["+Inf"][0] == 4


def test_hit_ratio_is_undefined_without_operations(spark):
    df = spark.createDataFrame([(0, 0), (3, 1)], "h long, m long")
    assert [r[0] for r in df.select(metrics.hit_ratio(F.col("h"), F.col("m"))).collect()] == [None, 0.75]


def events(seed, n=400):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice([0, 0, 1, 5, 40])
        rows.append((i, "hot" if rng.random() < 0.6 else f"c{rng.randrange(4)}", at))
    return rows


@pytest.mark.parametrize("limit, window, salts", [(1, 60, 4), (3, 60, 2), (5, 7, 32), (1000, 60, 4)])
def test_rejected_requests(spark, limit, window, salts):
    rows, seen, wanted = events(1), {}, {}
    for i, client, at in rows:
        slot = (client, at // window)
        seen[slot] = seen.get(slot, 0) + 1
        wanted[i] = seen[slot] > limit
    df = spark.createDataFrame(rows, "id long, client string, second long")
    out = ratelimit.rejected_requests(df, ["client"], "second", "id", limit, window, salts).collect()
    assert {r["id"]: r["rejected"] for r in out} == wanted and len(out) == len(rows)
    summary = ratelimit.limit_summary(df, ["client"], "second", limit, window)
    assert summary.agg(F.sum("rejected")).first()[0] == sum(wanted.values())


def test_burst_of_120_is_limited(spark):
    df = spark.range(120).select("id", F.lit("one").alias("client"), F.lit(5).alias("second"))
    assert ratelimit.rejected_requests(df, ["client"], "second", "id").where("rejected").count() == 20


@pytest.mark.parametrize("window, slice_seconds", [(60, None), (60, 61), (60, 5), (1, 500), (300, 100_000)])
def test_sliding_load(spark, window, slice_seconds):
    rows = events(2)
    df = spark.createDataFrame(rows, "id long, client string, second long")
    out = ratelimit.sliding_load(df, ["client"], "second", window, slice_seconds).collect()
    assert len(out) == len({(c, at) for _, c, at in rows})
    for r in out:
        assert r["load"] == sum(c == r["client"] and r["second"] - window <= at <= r["second"] for _, c, at in rows)


def test_one_label_uses_many_tasks(spark):
    """Seconds of one endpoint are dealt by time slices, both where they are summed up and where they trail."""
    df = spark.createDataFrame([(1, "e", 5, 9)], "id long, l string, s long, e long")
    for out in (ratelimit.sliding_load(df, ["l"], "s"), metrics.connection_load(df, "s", "e", "l")):
        windows = [p for p in partitionings(out) if "_sum_slice" in p and "second" not in p]
        assert windows and "hashpartitioning(l" not in " ".join(p for p in partitionings(out) if "," not in p)


@pytest.mark.parametrize("width", [1, 7, 100_000])
def test_running_sum(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["hot", "hot", "b", None]), i, rng.randrange(-5, 6)) for i in rng.sample(range(-500, 500), 300)]
    df = spark.createDataFrame(rows, "g string, at long, v long")
    for r in slices.running_sum(df, ["g"], "at", "v", "total", width).collect():
        assert r["total"] == sum(v for g, at, v in rows if g == r["g"] and at <= r["at"])
    assert slices.running_sum(df, [], "at", "v", "total", width).count() == 300


def test_rejections_leave_the_log_where_it_is(spark):
    """What is shuffled to rank is reduced within tasks first; the log itself meets the admitted by its ids."""
    df = spark.range(1000).select("id", F.lit("one").alias("client"), (F.col("id") % 7).alias("second"))
    text = plan(ratelimit.rejected_requests(df, ["client"], "second", "id"))
    assert text.count("WindowGroupLimit") >= 4 and text.count("hashpartitioning(id") <= 2


@pytest.mark.parametrize("gap", [2, 10, 60])
def test_sessions(spark, gap):
    rows, wanted, last = events(3), {}, {}
    for _, client, at in sorted(rows, key=lambda r: r[2]):
        if client not in last or at - last[client] > gap:
            wanted.setdefault(client, []).append([at, at, 0])
        wanted[client][-1][1] = at
        wanted[client][-1][2] += 1
        last[client] = at
    df = spark.createDataFrame([(i, c, at * 1_000_000) for i, c, at in rows], "id long, client string, at long")
    got = {}
    for r in metrics.sessions(df, "client", "at", gap).orderBy("client", "session").collect():
        got.setdefault(r["client"], []).append([r["first_micros"] // 1_000_000, r["last_micros"] // 1_000_000, r["requests"]])
    assert got == wanted


def test_connections(spark):
    df = spark.createDataFrame([("e", 1, 4), ("e", 2, 3), ("e", 2, 2)], "l string, s long, e long")
    got = [(r["second"], r["active"]) for r in metrics.connection_load(df, "s", "e", "l").orderBy("second").collect()]
    assert got == [(1, 1), (2, 2), (3, 1), (4, 0)]


def test_last_value_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 5, 1), ("a", 2.0, 5, 2), ("a", 9.0, 4, 3)], "l string, v double, ts long, id long")
    assert metrics.last_values(df, "v", "ts", "id", "l").first()["value"] == 2.0


@pytest.mark.parametrize("metric, value, message", [
    ("response_time_p95", 5.0, None), ("response_time_p95", 5.5, "response_time_p95 exceeded threshold: 5.500 > 5.0"),
    ("error_rate", 0.0501, "error_rate exceeded threshold: 0.050 > 0.05"), ("memory_usage", 0.9, None),
    ("cache_hit_ratio", 0.9, None), ("cache_hit_ratio", 0.5, "cache_hit_ratio fell below threshold: 0.500 < 0.7"),
    ("response_time_p95", 12345.678, "response_time_p95 exceeded threshold: 12345.678 > 5.0"), ("unknown", 99.0, None)])
def test_alerts(spark, metric, value, message):
    rows = alerts.alerts(spark.createDataFrame([(metric, value)], "metric string, value double")).collect()
    assert [r["message"] for r in rows] == ([] if message is None else [message])


@pytest.mark.parametrize("memory, cpu, up, status", [
    (90, 90, True, "healthy"), (91, 90, True, "degraded"), (91, 91, True, "degraded"), (91, 91, False, "unhealthy")])
def test_health(spark, memory, cpu, up, status):
    df = spark.createDataFrame([(memory, cpu, up)], "m int, c int, up boolean")
    errors = alerts.health_errors(F.col("m"), F.col("c"), F.col("up"))
    n = F.when(errors == "", 0).otherwise(F.size(F.split(errors, ";")))
    assert df.select(alerts.health_tier(n)).first()[0] == status


def test_span_tags_and_logs(spark):
    df = spark.createDataFrame([({"a": "1"}, [(1.0, "info", "x")]), (None, None)],
                               "tags map<string,string>, logs array<struct<timestamp:double,level:string,message:string>>")
    rows = df.select(tracing.set_tag(F.col("tags"), "a", F.lit("2")).alias("tags"),
                     tracing.add_log(F.col("logs"), F.lit(2.0), F.lit("y"), "error").alias("logs")).collect()
    assert [r["tags"] for r in rows] == [{"a": "2"}, {"a": "2"}]
    assert [[e["message"] for e in r["logs"]] for r in rows] == [["x", "y"], ["y"]]


def test_span_request_join_keeps_all_spans(spark):
    spans = spark.createDataFrame([("s1", "r1"), ("s2", "r1"), ("s3", "gone")], "span_id string, request_id string")
    requests = spark.createDataFrame([("r1", 200)], "request_id string, status int")
    assert {(r["span_id"], r["status"]) for r in tracing.with_requests(spans, requests).collect()} == {
        ("s1", 200), ("s2", 200), ("s3", None)}


def test_canary_share(spark):
    share = spark.range(20_000).where(canary.arm(F.col("id"), 20) == "canary").count() / 20_000
    assert 0.18 < share < 0.22


@pytest.mark.parametrize("way", ["broadcast", "salted", "joined index"])
def test_named_entities(spark, monkeypatch, way):
    if way == "salted":
        monkeypatch.setattr("wardline.operators.joins.is_small", lambda *a, **k: False)
    if way == "joined index":
        monkeypatch.setattr("wardline.operators.gazetteer.INDEX_WORDS", 2)
    names = spark.createDataFrame([
        ("John Smith", "PERSON"), ("Smith", "PERSON"), ("Acme", "ORG"), ("New York City", "GPE"), ("Acme", "ORG"),
        (None, "ORG"), ("Smith", None), ("O'Brien", "PERSON"), ("St. Louis", "GPE")], "name string, label string")
    texts = spark.createDataFrame([
        (1, "My name is John Smith, of Acme."), (2, "John, Smith in  New York City"), (3, "Smithsonian acme"), (4, ""),
        (5, "New York City's John  Smith"),
        (6, "St. Louis, said O'Brien"), (7, "O-Brien of St Louis")], "id long, text string")
    got = {r["id"]: (r["entities"], r["redacted_text"]) for r in with_entities(texts, names, "id").collect()}
    assert got[1] == (["PERSON: John Smith", "PERSON: Smith", "ORG: Acme"],
                      "My name is [PERSON_REDACTED], of [ORG_REDACTED].")
    assert got[2] == (["PERSON: Smith", "GPE: New York City"], "John, [PERSON_REDACTED] in  [GPE_REDACTED]")
    assert got[3] == ([], "Smithsonian acme") and got[4] == ([], "")
    assert got[5][0] == ["GPE: New York City", "PERSON: Smith"]
    assert got[6][0] == ["GPE: St. Louis", "PERSON: O'Brien"] and got[7][0] == []
    friendly = with_entities(texts.where("id = 2"), names, "id", friendly=True).first()["redacted_text"]
    assert friendly == "John, [PERSON_REDACTED] in  [LOCATION_REDACTED]"


@pytest.mark.parametrize("listed", [0, 20_000])
def test_long_names_and_candidates(spark, monkeypatch, listed):
    monkeypatch.setattr("wardline.operators.gazetteer.INDEX_WORDS", listed)
    names = spark.createDataFrame([("Bank of the United States of America", "ORG"), ("the United", "ORG"), ("Anna", "PERSON")],
                                  "name string, label string")
    texts = spark.createDataFrame([
        (1, "Was the Bank of the United States of America in the United Kingdom?"), (2, "Bank of the river"),
        (3, "no word begins a name here"), (4, "Anna " * 500), (5, None)], "id long, text string")
    got = {r["id"]: r["entities"] for r in with_entities(texts, names, "id").collect()}
    assert got == {1: ["ORG: the United", "ORG: Bank of the United States of America"][::-1], 2: [], 3: [],
                   4: ["PERSON: Anna"], 5: None} or got[5] in (None, [])
    assert got[1] == ["ORG: Bank of the United States of America", "ORG: the United"] and got[4] == ["PERSON: Anna"]
    runs = names.withColumn("_run", F.col("name"))
    cut = texts.where("text is not null").select("id", F.split("text", " ").alias("_tokens"))
    starts = candidate_runs(cut, runs, "id").groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in starts}.get(3) is None and max(r["count"] for r in starts) <= 9
