"""Admission, sources, sinks."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wardline.operators import admission, engine
from wardline.session import scratch_dir
from wardline.sources import logs, sinks, tables


@pytest.mark.parametrize("text, ttl, reason", [
    ("hello", None, None), ("hello", 0, None), ("hello", 3600, None), ("x" * 50000, None, None),
    ("", None, "empty_text"), ("   \n\t   ", None, "blank_text"), ("\u00a0\u2003\u3000", None, "blank_text"),
    ("abcdefghijklmnopqrstuvwxyz" * 10000, None, "text_too_long"), (" " * 50001, None, "text_too_long"),
    (None, None, "missing_text"), ("hello", 3601, "ttl_out_of_range"), ("hello", -1, "ttl_out_of_range")])
def test_admission(spark, text, ttl, reason):
    df = spark.createDataFrame([(text, ttl)], "text string, ttl int")
    out = admission.screened(df, ttl="ttl")
    assert out.first()["reject_reason"] == reason
    assert admission.accepted(out).count() + admission.quarantined(out).count() == 1


@pytest.mark.parametrize("text", ["  a b ", "\u00a0a\u2028", "\x1fa\x85", "a", "\ta\n\n", "\u200ba"])
def test_accepted_text_is_stripped_like_python(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    assert admission.accepted(admission.screened(df)).first()["text"] == text.strip()


def test_batch_bounds(spark):
    rows = [("small", "t")] * 1 + [("full", "t")] * 100 + [("over", "t")] * 101
    df = spark.createDataFrame(rows, "batch_id string, text string")
    got = {r["batch_id"]: (r["n_texts"], r["accepted"]) for r in admission.batch_sizes(df).collect()}
    assert got == {"small": (1, True), "full": (100, True), "over": (101, False)}


def test_batch_texts_keep_their_order(spark):
    df = spark.createDataFrame([("b", ["x", "y", None, "x"]), ("empty", [])], "batch_id string, texts array<string>")
    rows = tables.batch_texts(df).orderBy("pos").collect()
    assert [(r["batch_id"], r["pos"], r["text"]) for r in rows] == [
        ("b", 0, "x"), ("b", 1, "y"), ("b", 2, None), ("b", 3, "x")]


def test_fewer_or_no_contexts_drop_no_text(spark):
    df = spark.createDataFrame([("a", ["x", "y"], ["c"]), ("b", ["z"], None), ("c", ["w"], ["d", "spare"])],
                               "batch_id string, texts array<string>, contexts array<string>")
    rows = tables.texts_with_contexts(df).collect()
    assert {(r["batch_id"], r["text"], r["context"]) for r in rows} == {
        ("a", "x", "c"), ("a", "y", None), ("b", "z", None), ("c", "w", "d")}


def test_chunk_ids(spark):
    ids = [r[0] for r in spark.range(100).select(engine.batch_request_id(F.lit("b"), F.col("id"))).collect()]
    assert sorted(set(ids)) == ["batch_b_0", "batch_b_32", "batch_b_64", "batch_b_96"]
    assert ids[31] == "batch_b_0" and ids[32] == "batch_b_32"


def test_requests_as_json(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"request_id": "1", "text": "hi", "guardrail": "strict", "context": {"user_id": "u", "metadata": {"k": "v"}}}\n'
        '{"request_id": "2", "text": "ho", "cache_ttl": 60, "skip_cache": true}\n')
    first, second = tables.requests(spark, str(tmp_path), "json").orderBy("request_id").collect()
    assert first["context"]["metadata"] == {"k": "v"} and first["cache_ttl"] is None
    assert second["skip_cache"] and second["guardrail"] is None


def test_access_log(spark):
    line = ('10.0.0.9 - bob [02/Jan/2024:03:04:05 +0000] "GET /health HTTP/1.1" 200 17 "-" "curl/8" "-" '
            'rt=0.125 uct="0.001" uht="0.002" urt="{}"')
    df = spark.createDataFrame([(line.format("0.1"),), (line.format("-"),), ("garbage",)], "value string")
    good, no_upstream, bad = logs.parse_access_log(df).collect()
    assert (good["ip"], good["remote_user"], good["request"], good["status"], good["bytes"]) == (
        "10.0.0.9", "bob", "GET /health HTTP/1.1", 200, 17)
    assert good["request_time"] == 0.125 and good["upstream_time"] == 0.1 and good["malformed"] is None
    assert no_upstream["upstream_time"] is None and no_upstream["status"] == 200
    assert bad["malformed"] == "garbage" and bad["status"] is None


@pytest.mark.parametrize("old, new", [("02/Jan", "31/Feb"), ("rt=0.125", "rt=1.2.3"), (" 17 ", f" {10**30} ")])
def test_access_log_goes_on_after_a_broken_value(spark, old, new):
    line = ('10.0.0.9 - bob [02/Jan/2024:03:04:05 +0000] "GET /health HTTP/1.1" 200 17 "-" "curl/8" "-" '
            'rt=0.125 uct="0.001" uht="0.002" urt="0.1"')
    broken, good = logs.parse_access_log(
        spark.createDataFrame([(line.replace(old, new),), (line,)], "value string")).collect()
    assert broken["malformed"] == line.replace(old, new) and broken["ip"] == "10.0.0.9"
    assert good["malformed"] is None and good["bytes"] == 17


def test_store_partitions_are_pruned(spark):
    path = scratch_dir(spark, "prune")
    rows = spark.range(10).select(
        F.col("id").cast("string").alias("cache_key"), F.timestamp_seconds(F.col("id") * 86400).alias("written_at"),
        F.timestamp_seconds(F.col("id") * 86400 + 300).alias("expires_at")).withColumn("expires_on", F.to_date("expires_at"))
    sinks.write_store(rows, path)
    live = sinks.read_store(spark, path, F.timestamp_seconds(F.lit(8 * 86400 + 10)))
    assert sorted(r["cache_key"] for r in live.collect()) == ["8", "9"]
    assert "PartitionFilters: [isnotnull(expires_on" in live._jdf.queryExecution().toString()


def test_scratch_folder_is_the_shared_one(spark, shared):
    assert scratch_dir(spark, "a") != scratch_dir(spark, "a")
    assert scratch_dir(spark, "a").startswith(f"{shared}/a-")


@pytest.mark.parametrize("master, allowed", [("local[4]", True), ("yarn", False)])
def test_only_local_sessions_may_leave_it_unset(master, allowed):
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default),
                           sparkContext=SimpleNamespace(master=master))
    if allowed:
        assert "wardline-" in scratch_dir(bare, "a")
    else:
        with pytest.raises(RuntimeError):
            scratch_dir(bare, "a")


def test_documents_scan_reads_only_needed_columns(spark, data):
    plan = tables.documents(spark, data).select("doc_id", F.length("text"))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_batches_are_answered_in_order_or_turned_away(spark):
    from wardline.operators import requests

    batches = spark.createDataFrame([
        ("a", ["fine text here", "you stupid idiot moron", "", "fine text here"], "batch_optimized", 300, False),
        ("b", ["fine text here", None], "strict", 300, False), ("none", [], "default", 300, False),
        ("null", None, "default", 300, False), ("many", ["x y z"] * 101, "default", 300, False),
        ("past", ["fine text here"], "batch_optimized", 300, True)],
        "batch_id string, texts array<string>, guardrail string, cache_ttl int, skip_cache boolean")
    stored = batches.limit(0).select(F.lit("x").alias("cache_key"), F.lit("t").alias("text"), F.lit("default").alias("resolved"))
    live = requests.scorer()(stored).select("cache_key", *requests.RESULTS)
    got = {r["batch_id"]: r for r in requests.answer_batches(batches, live).collect()}
    assert set(got) == {"a", "b", "none", "null", "many", "past"}
    assert {k for k, r in got.items() if r["status"] == "failure"} == {"none", "null", "many"}
    a = got["a"]
    assert a["message"] == "Batch validation completed: 4 texts processed"
    assert [(r["pos"], r["valid"], r["reject_reason"]) for r in a["results"]] == [
        (0, True, None), (1, False, None), (2, False, "empty_text"), (3, True, None)]
    assert (a["total_processed"], a["total_valid"], a["cache_hits"], a["cache_misses"]) == (4, 2, 1, 3)
    assert got["b"]["total_processed"] == 2 and not got["b"]["results"][1]["valid"]
    assert got["past"]["cache_hits"] == 0
