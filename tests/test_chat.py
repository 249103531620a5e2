"""Safety verdicts, gates and conversations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wardline.functions import safety
from wardline.operators import conversation, engine


@pytest.mark.parametrize("raw, is_safe, confidence, found", [
    ("safe", True, 0.95, []), ("  SAFE  ", True, 0.95, []),
    ("unsafe", False, 0.9, ["Content violates safety guidelines"]),
    ("unsafe: violence", False, 0.9, ["Detected violence content"]),
    ("unsafe self-harm", False, 0.9, ["Detected violence content", "Detected self_harm content"]),
    ("UNSAFE racist and illegal", False, 0.9, ["Detected hate_speech content", "Detected illegal content"]),
    ("", False, 0.5, ["Content classification unclear"]), ("maybe", False, 0.5, ["Content classification unclear"]),
    (None, False, 0.5, ["Content classification unclear"])])
def test_verdicts(spark, raw, is_safe, confidence, found):
    df = spark.createDataFrame([(raw,)], "raw string")
    v = df.select(safety.parsed(F.col("raw")).alias("v")).first()["v"]
    assert (v["is_safe"], v["confidence"], v["violations"]) == (is_safe, confidence, found)
    assert v["safety_level"] == ("safe" if is_safe else "unsafe")


def test_scorer_error_is_unsafe(spark):
    df = spark.createDataFrame([("safe", "boom")], "raw string, e string")
    v = df.select(safety.parsed(F.col("raw"), F.col("e")).alias("v")).first()["v"]
    assert not v["is_safe"] and v["confidence"] == 0.0 and v["violations"] == ["Validation error: boom"]


@pytest.mark.parametrize("context, prompt", [
    ("user_input", "Context: user_input\n\nText: hi"), ("", "hi"), (None, "hi")])
def test_prompt(spark, context, prompt):
    df = spark.createDataFrame([("hi", context)], "t string, c string")
    assert df.select(safety.prompt(F.col("t"), F.col("c"))).first()[0] == prompt


def test_truncation_is_by_words(spark):
    df = spark.createDataFrame([(" ".join(map(str, range(3000))),)], "t string")
    assert df.select(safety.truncated_prompt(F.col("t"))).first()[0].split(" ")[-1] == "2047"


@pytest.mark.parametrize("text, is_safe", [
    ("Hello, how are you today?", True), ("I hope you have a wonderful day!", True),
    ("This is a test of potentially harmful content.", False), ("bullying is illegal", False)])
def test_default_scorer(spark, text, is_safe):
    df = spark.createDataFrame([(text,)], "t string")
    raw = safety.keyword_verdict(safety.prompt(F.col("t"), F.lit("user_input")))
    assert df.select(safety.says_safe(raw)).first()[0] is is_safe


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        (1, 0, "system", "be nice"), (1, 1, "user", "hello"), (1, 2, "assistant", "Hello! How can I help you today?"),
        (1, 3, "user", "toxic please"), (1, 4, "assistant", "You're stupid and should shut up!"),
        (1, 5, "user", "email"), (1, 6, "assistant", "You can contact me at support@example.com or call 555-123-4567"),
        (1, 7, "user", "bye"),
        (2, 0, "user", "you stupid idiot"), (2, 1, "assistant", "Goodbye! Have a great day!"),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_pairs(turns):
    got = {(r["conv_id"], r["turn"], r["reply_turn"]) for r in conversation.turn_pairs(turns).collect()}
    assert got == {(1, 1, 2), (1, 3, 4), (1, 5, 6), (2, 0, 1)}


def test_outcomes_under_strict(turns):
    got = {(r["conv_id"], r["turn"]): (r["outcome"], r["response"])
           for r in conversation.turn_outcomes(turns, "strict").collect()}
    assert got[1, 1] == ("delivered", "Hello! How can I help you today?")
    assert got[1, 3] == ("blocked_output", conversation.OUTPUT_BLOCKED)
    assert got[1, 5] == ("delivered", "You can contact me at [EMAIL_REDACTED] or call [PHONE_REDACTED]")
    assert got[1, 7] == ("unanswered", None)
    assert got[2, 0] == ("blocked_input", conversation.INPUT_BLOCKED)


def test_single_insult_passes_default(turns):
    got = {(r["conv_id"], r["turn"]): r["outcome"] for r in conversation.turn_outcomes(turns, "default").collect()}
    assert got[1, 3] == "delivered" and got[2, 0] == "blocked_input"


def test_rollup(turns):
    got = {r["conv_id"]: r for r in conversation.conversation_rollup(
        conversation.turn_outcomes(turns, "strict")).collect()}
    assert (got[1]["user_turns"], got[1]["blocked_outputs"], got[1]["delivered"], got[1]["clean"]) == (4, 1, 2, False)
    assert got[2]["blocked_inputs"] == 1


def test_turn_safety_and_filter(turns, spark):
    rows = conversation.turn_safety(turns)
    assert all(r["conversation_safe"] == (r["user_input_safe"] and r["ai_output_safe"]) for r in rows.collect())
    flags = spark.createDataFrame([(True,), (False,), (None,)], "is_safe boolean")
    assert conversation.only_safe(flags).count() == 1


def test_service_failure_closes_unless_told(spark):
    df = spark.createDataFrame([("hi", "down")], "text string, e string")
    verdicts = engine.validate(df, engine_error="e")
    assert conversation.gate(verdicts).first()["blocked"]
    assert not conversation.gate(verdicts, fail_open=True).first()["blocked"]
    assert conversation.gate(verdicts, fail_open=True).first()["gated_text"] == "hi"


def test_context_keeps_set_ids(spark):
    df = spark.createDataFrame([("u", None), ("", "s"), (None, None)], "u string, s string")
    got = [r[0] for r in df.select(conversation.request_context(F.col("u"), F.col("s"))).collect()]
    assert got == [{"user_id": "u"}, {"session_id": "s"}, {}]


@pytest.mark.parametrize("slice_turns", [2, 5, 1000])
def test_pairs_over_holes_and_slices(spark, slice_turns):
    rng = random.Random(slice_turns)
    rows = [(c, t, rng.choice(["user", "assistant", "system"])) for c in range(5) for t in sorted(rng.sample(range(60), 25))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string")
    got = {(r["conv_id"], r["turn"]): r["next"] and tuple(r["next"])
           for r in conversation.following(df, "role", slice_turns=slice_turns).collect()}
    want = {(a[0], a[1]): b[1:] if b and b[0] == a[0] else None for a, b in zip(rows, [*rows[1:], None])}
    assert got == want


def test_a_reply_after_a_hole_answers(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello"), (1, 10, "assistant", "hi")],
                               "conv_id long, turn long, role string, text string")
    assert conversation.turn_outcomes(df).first()["outcome"] == "delivered"
    assert conversation.turn_pairs(df).first()["reply_turn"] == 10


def test_missing_turns(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 3)], "conv_id long, turn long")
    assert [(r["conv_id"], r["missing"]) for r in conversation.missing_turns(df).collect()] == [(2, 2)]


def test_real_gaps_of_the_whole_table_are_reported(spark, tmp_path):
    """Turn 1 of conversation 4 and turn 2 of conversation 3 are those that turn_gaps leaves out."""
    from wardline.plans.chat_queries import turn_gap_counts

    rows = [(c, t, "user", "hello") for c, turns in ((3, (0, 1, 2, 3)), (4, (0, 1, 2, 5))) for t in turns]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, turn_gap_counts(spark, str(tmp_path)).collect())) == [(3, 0), (4, 2)]


def test_pairs_and_outcomes_over_made_holes(spark):
    """Every fourth turn of made conversations is lost: a user turn is answered by what follows next."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(12) for t in range(9)
            if (c + t) % 4 != 1]
    wanted = {}
    for c in range(12):
        own = [r for r in rows if r[0] == c]
        for here, after in zip(own, own[1:] + [None]):
            if here[2] == "user":
                wanted[c, here[1]] = after[1] if after and after[2] == "assistant" else None
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = {(r["conv_id"], r["turn"]): r["reply_turn"] for r in conversation.turn_pairs(df).collect()}
    assert pairs == {k: v for k, v in wanted.items() if v is not None}
    outcomes = {(r["conv_id"], r["turn"]): r["outcome"] for r in conversation.turn_outcomes(df).collect()}
    assert outcomes == {k: "unanswered" if v is None else "delivered" for k, v in wanted.items()}
    gaps = {r["conv_id"]: r["missing"] for r in conversation.missing_turns(df).collect()}
    assert set(gaps.values()) <= {1, 2} and gaps
