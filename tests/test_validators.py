"""Validators, scorers and the engine on small texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wardline.functions import pii, scorers
from wardline.operators import engine
from wardline.operators.validators import (
    VALIDATORS, NameColumns, pii_detection, sentiment_check, toxicity_check,
)
from wardline.plans import policies
from wardline.plans.policies import CheckSpec, Policy
from wardline.schemas import LABEL_SCORES

TEXTS = {
    "normal": "The ferry leaves at noon from the second pier.",
    "toxic": "Only a moron or a clown would park there.",
    "long": "One more line about the weather at sea. " * 60,
    "pii": "Mary Poole answers under mary.poole@harbour.example all week.",
    "negative": "An awful trip, and the cabin was horrible.",
}


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(list(TEXTS.items()), "name string, text string")


def verdicts(df, guardrail, **options):
    return {r["name"]: r for r in engine.validate(df, guardrail, **options).collect()}


def one(spark, text, check, **options):
    registry = {"default": Policy("default", "", (check,))}
    df = spark.createDataFrame([(text,)], "text string")
    row = engine.validate(df, registry=registry, **options).first()
    return row, row["validations"][0]


def test_sample_texts_under_default(sample):
    got = verdicts(sample, "default")
    assert {n: r["valid"] for n, r in got.items()} == {
        "normal": True, "toxic": False, "long": False, "pii": True, "negative": False}
    assert got["negative"]["action"] == "pass"  # only logged
    assert got["toxic"]["action"] == "block"
    assert all(r["status"] == "success" for r in got.values())
    assert [v["validator_name"] for v in got["normal"]["validations"]] == [
        "length_check", "toxicity_check", "sentiment_check"]


def test_sample_texts_under_strict(sample):
    got = verdicts(sample, "strict")
    assert got["pii"]["processed_text"] == "Mary Poole answers under [EMAIL_REDACTED] all week."
    assert got["pii"]["action"] == "filter" and not got["pii"]["valid"]
    assert got["normal"]["processed_text"] is None
    assert got["normal"]["skipped_validators"] == ["spam_detection"]
    assert got["normal"]["valid"]  # a skipped check does not count


def test_length_boundary(spark):
    check = CheckSpec("length_check", 100)
    assert one(spark, "x" * 100, check)[0]["valid"]
    row, result = one(spark, "x" * 101, check)
    assert not row["valid"] and result["confidence"] is None
    assert result["message"] == "Text length (101) exceeds maximum allowed (100)"


@pytest.mark.parametrize("missing, text", [("length_check", "x" * 1001), ("toxicity_check", "idiot stupid moron"),
                                           ("sentiment_check", "awful")])
def test_parameters_left_out_have_defaults(spark, missing, text):
    assert not one(spark, text, CheckSpec(missing))[0]["valid"]


def test_toxicity_score_equal_to_threshold_passes(spark):
    row, result = one(spark, "what an idiot", CheckSpec("toxicity_check", None, 0.5))
    assert row["valid"] and result["confidence"] == 0.5 and result["message"] == "No toxicity detected"
    row, result = one(spark, "Idiot, STUPID", CheckSpec("toxicity_check", None, 0.5))
    assert not row["valid"] and result["confidence"] == 0.75
    assert result["message"] == "Toxicity detected (confidence: 0.750)"


def test_toxic_words_count_once_and_only_whole(spark):
    _, result = one(spark, "idiot idiot idiotic", CheckSpec("toxicity_check", None, 0.1))
    assert result["confidence"] == 0.5


def test_sentiment_boundary(spark):
    row, result = one(spark, "good bad bad awful terrible", CheckSpec("sentiment_check", None, -0.5))
    assert row["valid"] and result["confidence"] == 0.5  # (1 - 3) / 4
    row, _ = one(spark, "bad awful", CheckSpec("sentiment_check", None, -1.0))
    assert row["valid"]
    row, result = one(spark, "bad awful", CheckSpec("sentiment_check", None, -0.5))
    assert result["message"] == "Negative sentiment detected (score: -1.000)"


@pytest.mark.parametrize("labels, score", [
    ([("NON_TOXIC", 0.1)], 0.0), ([("TOXIC", 0.9)], 0.9), ([("NON_TOXIC", 0.8), ("severe_toxic", 0.3)], 0.3),
    ([("toxic", 0.2), ("TOXIC", 0.7)], 0.7), ([], 0.0)])
def test_reduction_of_toxicity_labels(spark, labels, score):
    df = spark.createDataFrame([(labels,)], f"labels {LABEL_SCORES.simpleString()}")
    assert df.select(scorers.toxicity_of_labels(F.col("labels"))).first()[0] == score


@pytest.mark.parametrize("labels, score, passes", [
    ([("POSITIVE", 0.9)], 0.9, True), ([("NEGATIVE", 0.9)], -0.9, False), ([("neutral", 0.9)], 0.0, True),
    ([("NEGATIVE", 0.2), ("POSITIVE", 0.8)], 0.8, True), ([], 0.0, True)])
def test_sentiment_labels(spark, labels, score, passes):
    df = spark.createDataFrame([("t", labels)], f"text string, labels {LABEL_SCORES.simpleString()}").withColumn(
        "s", scorers.polarity_of_labels(F.col("labels")))
    assert df.first()["s"] == score
    known = VALIDATORS.with_validator(sentiment_check(scorers.ScoreColumns("s", "given")))
    registry = {"default": Policy("default", "", (CheckSpec("sentiment_check", None, -0.5),))}
    assert engine.validate(df, registry=registry, validators=known).first()["valid"] is passes


def test_scorer_error_fails_closed(spark):
    df = spark.createDataFrame([("t", 0.0, "boom"), ("t", 0.0, None)], "text string, s double, e string")
    known = VALIDATORS.with_validator(toxicity_check(scorers.ScoreColumns("s", "given", "e")))
    registry = {"default": Policy("default", "", (CheckSpec("toxicity_check", None, 0.7),))}
    broken, fine = engine.validate(df, registry=registry, validators=known).collect()
    assert not broken["valid"] and broken["validations"][0]["message"] == "Toxicity validation error: boom"
    assert broken["validations"][0]["confidence"] is None
    assert fine["valid"] and fine["validations"][0]["model_version"] == "given"


@pytest.mark.parametrize("text, entities, redacted", [
    ("mail a@b.com or 555-123-4567 or c.d@e.co.uk",
     ["EMAIL: a@b.com", "PHONE: 555-123-4567", "EMAIL: c.d@e.co.uk"],
     "mail [EMAIL_REDACTED] or [PHONE_REDACTED] or [EMAIL_REDACTED]"),
    ("same x@y.org x@y.org", ["EMAIL: x@y.org", "EMAIL: x@y.org"], "same [EMAIL_REDACTED] [EMAIL_REDACTED]"),
    ("call +1 (555) 123-4567", ["PHONE: +1 (555) 123-4567"], "call [PHONE_REDACTED]"),
    ("555-123-4567@x.com", ["EMAIL: 555-123-4567@x.com"], "[EMAIL_REDACTED]"),
    ("a @ b - c", [], "a @ b - c"), ("", [], "")])
def test_pii(spark, text, entities, redacted):
    df = spark.createDataFrame([(text,)], "text string")
    row = df.select(pii.pii_entities(F.col("text")).alias("e"), pii.pii_redacted(F.col("text")).alias("r")).first()
    assert row["e"] == entities and row["r"] == redacted
    again = spark.createDataFrame([(row["r"],)], "text string").select(pii.pii_redacted(F.col("text"))).first()[0]
    assert again == redacted


def test_friendly_tags(spark):
    labels = spark.createDataFrame([("ORG",), ("GPE",), ("EMAIL",)], "label string")
    plain = [r[0] for r in labels.select(pii.redaction_tag_column(F.col("label"))).collect()]
    friendly = [r[0] for r in labels.select(pii.redaction_tag_column(F.col("label"), True)).collect()]
    assert plain == ["[ORG_REDACTED]", "[GPE_REDACTED]", "[EMAIL_REDACTED]"]
    assert friendly == ["[ORGANIZATION_REDACTED]", "[LOCATION_REDACTED]", "[EMAIL_REDACTED]"]
    row, result = one(spark, "a@b.com", CheckSpec("pii_detection", on_fail="filter"),
                      validators=VALIDATORS.with_validator(pii_detection(friendly=True)))
    assert result["message"] == "PII detected: EMAIL: a@b.com" and row["processed_text"] == "[EMAIL_REDACTED]"


def test_null_text_and_empty_table(spark):
    nothing = spark.createDataFrame([(None, "strict")], "text string, guardrail string")
    for row in (engine.validate(nothing, "permissive").first(), engine.validate(nothing, "strict").first(),
                engine.validate_mixed(nothing).first()):
        assert row["status"] == "success" and row["valid"] is False
        assert all(v["status"] == "fail" and v["message"].endswith(": no result") for v in row["validations"])
    assert engine.validate(nothing, "strict").first()["action"] == "block"
    empty = spark.createDataFrame([], "text string")
    assert engine.validate(empty, "strict").count() == 0


def test_null_score_fails(spark):
    df = spark.createDataFrame([("fine", None), ("fine", 0.1)], "text string, s double")
    known = VALIDATORS.with_validator(toxicity_check(scorers.ScoreColumns("s", "model-1")))
    registry = {"default": Policy("default", "", (CheckSpec("toxicity_check", None, 0.5),))}
    missing, scored = engine.validate(df, registry=registry, validators=known).collect()
    assert missing["valid"] is False and missing["action"] == "block" and scored["valid"] is True


def test_policy_table_without_default_uses_the_built_in_one(spark):
    table = policies.policy_rows(spark).where("guardrail <> 'default'")
    df = spark.createDataFrame([(1, "a clown and an idiot", "unlisted"), (2, "a quiet day", None)],
                               "id long, text string, guardrail string")
    rows = {r["id"]: r for r in engine.validate_with_table(df, table, "id").collect()}
    assert rows[1]["resolved_guardrail"] == "default" and rows[1]["valid"] is False and rows[1]["action"] == "block"
    assert rows[2]["valid"] is True and len(rows[2]["validations"]) == 3


def test_names_reach_the_check(spark):
    df = spark.createDataFrame([
        (TEXTS["pii"], [("PERSON", "Mary Poole"), ("PERSON", "Poole"), ("GPE", "Elsewhere")], None),
        ("From Oslo to Acme", [("ORG", "Acme"), ("GPE", "Oslo")], None), ("unread", None, "out of memory"), ("plain", None, None),
    ], f"text string, names {pii.NAMES}, e string")
    known = VALIDATORS.with_validator(pii_detection(friendly=True, recognizer=NameColumns("names", "names-1", "e")))
    rows = engine.validate(df, "strict", validators=known).collect()
    checks = [next(v for v in r["validations"] if v["validator_name"] == "pii_detection") for r in rows]
    assert checks[0]["entities"] == ["PERSON: Mary Poole", "PERSON: Poole", "EMAIL: mary.poole@harbour.example"]
    assert rows[0]["processed_text"] == "[PERSON_REDACTED] answers under [EMAIL_REDACTED] all week."
    assert rows[1]["processed_text"] == "From [LOCATION_REDACTED] to [ORGANIZATION_REDACTED]"
    assert checks[2]["status"] == "fail" and checks[2]["message"] == "PII validation error: out of memory"
    assert rows[3]["valid"] and checks[3]["model_version"] == "names-1"


def test_engine_error_is_a_failure(spark):
    df = spark.createDataFrame([("fine", None), ("fine", "disk full")], "text string, problem string")
    good, bad = engine.validate(df, engine_error="problem").collect()
    assert good["status"] == "success" and good["valid"]
    assert bad["status"] == "failure" and not bad["valid"] and bad["validations"] == []
    assert bad["message"] == "Internal error during validation: disk full"


@pytest.mark.parametrize("name", list(policies.REGISTRY))
def test_mixed_equals_single(sample, name):
    columns = ["name", "resolved_guardrail", "valid", "validations", "processed_text", "action",
               "skipped_validators", "status", "message"]
    single = engine.validate(sample, name).select(*columns).orderBy("name").collect()
    mixed = engine.validate_mixed(sample.withColumn("guardrail", F.lit(name))).select(*columns)
    assert mixed.orderBy("name").collect() == single


@pytest.mark.parametrize("rows", [200_000, 0])
def test_policy_table_equals_registry(spark, sample, monkeypatch, rows):
    """Both ways of the lookup: broadcast, and the salted join for tables beyond the bound."""
    if not rows:
        monkeypatch.setattr("wardline.operators.joins.is_small", lambda *a, **k: False)
    named = sample.withColumn("guardrail", F.when(F.col("name") == "pii", "strict").when(
        F.col("name") == "toxic", "no such policy").otherwise("permissive"))
    columns = ["name", "resolved_guardrail", "valid", "validations", "action", "skipped_validators"]
    table = engine.validate_with_table(named, policies.policy_rows(spark), "name").select(*columns)
    mixed = engine.validate_mixed(named).select(*columns)
    assert table.orderBy("name").collect() == mixed.orderBy("name").collect()


def test_results_keep_their_order_and_contract(sample):
    rows = engine.validator_results(engine.validate(sample, "content_moderation"), "name").collect()
    assert len(rows) == 4 * len(TEXTS)
    for row in rows:
        assert row["status"] in ("pass", "fail") and row["on_fail_action"] in policies.ON_FAIL_ACTIONS
        assert row["confidence"] is None or 0 <= row["confidence"] <= 1
        assert row["validator_name"] == policies.REGISTRY["content_moderation"].checks[row["pos"]].validator


def test_compare_policies_equals_single_runs(sample):
    got = {r["guardrail"]: r["valid_texts"] for r in engine.compare_policies(
        sample, list(policies.REGISTRY)).collect()}
    for name in policies.REGISTRY:
        assert got[name] == engine.validate(sample, name).where("valid").count()


def test_single_policy_needs_no_shuffle_and_one_tokenization(sample):
    plan = engine.validate(sample, "strict").select("name", "valid", "action")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "Exchange" not in text and "PythonUDF" not in text
    assert plan.optimizedPlan().toString().count("AS _once__toxicity_check__score") == 1


def test_filter_on_a_verdict_does_not_score_again(sample):
    failing = engine.validate(sample, "strict").where("not valid").select("name", "action")
    lines = failing._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("split(" in line for line in lines) == 1
    assert any("Filter" in line and "split(" not in line for line in lines)
    assert failing.count() == 4


def test_registry(spark):
    assert list(policies.REGISTRY) and set(policies.REGISTRY) == {
        "default", "strict", "permissive", "batch_optimized", "content_moderation", "customer_service"}
    assert policies.resolve_name("nope") == "default"
    assert policies.REGISTRY["strict"].version != policies.CONFIG["strict"].version
    drift = {(r["guardrail"], r["validator"], r["only_in"]) for r in policies.registry_drift(spark).collect()}
    assert ("strict", "spam_detection", "first") in drift
    assert {g for g, _, side in drift if side == "second"} == {"content_moderation", "customer_service"}
    assert policies.model_options(spark).groupBy("validator").count().where("count = 3").count() == 3
    capped = policies.cap_lengths({"p": Policy("p", "", (CheckSpec("length_check", 50_000),))})
    assert capped["p"].checks[0].max_length == 10_000
    with pytest.raises(ValueError):
        CheckSpec("length_check", on_fail="explode")


def test_registries_side_by_side(spark):
    from wardline.plans import policies

    schema = policies.POLICY_CHECKS
    first = spark.createDataFrame([("a", 0, "length_check", 10, None, "exception"), ("a", 1, "x", None, 0.5, "log"),
                                   (None, 0, "length_check", 5, None, "log")], schema)
    second = spark.createDataFrame([("a", 0, "length_check", 20, None, "log"), ("a", 1, "y", None, 0.1, "log"),
                                    ("b", 0, "x", None, 0.2, "filter"), (None, 0, "length_check", 5, None, "log")], schema)
    merged = {(r["guardrail"], r["validator"]): (r["winner"], r["max_length"], r["threshold"])
              for r in policies.registry_merge(first, second).collect()}
    assert merged == {("a", "length_check"): ("first", 10, None), ("a", "x"): ("first", None, 0.5),
                      (None, "length_check"): ("first", 5, None), ("b", "x"): ("second", None, 0.2)}
    drift = {(r["guardrail"], r["validator"]): r["drift"] for r in policies.registry_differences(first, second).collect()}
    assert drift == {("a", "length_check"): "differs: max_length,on_fail", ("a", "x"): "first only",
                     ("a", "y"): "second only", ("b", "x"): "second only"}


def test_validity_under_several_registries(spark):
    from wardline.operators import engine
    from wardline.plans import policies

    df = spark.createDataFrame([(1, "strict", "fine"), (2, "strict", "x" * 600), (3, "customer_service", "y" * 2000),
                                (4, "batch_optimized", "good"), (5, "default", None)], "id long, guardrail string, text string")
    out = engine.validity_under(df, {"one": policies.SERVICE, "two": policies.CONFIG})
    assert out.columns == ["id", "guardrail", "text", "one", "two"]
    assert {r["id"]: (r["one"], r["two"]) for r in out.collect()} == {
        1: (True, True), 2: (False, False), 3: (False, True), 4: (True, True), 5: (False, False)}
    for name, registry in (("one", policies.SERVICE), ("two", policies.CONFIG)):
        mixed = {r["id"]: r["valid"] for r in engine.validate_mixed(df, registry=registry).collect()}
        assert mixed == {r["id"]: r[name] for r in out.collect()}
