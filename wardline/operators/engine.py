"""The policy engine: texts in, verdicts out.

One policy for a whole table folds into two projections and needs no shuffle. A policy per row picks
its list of checks from literals, or from a policy table by a lookup join, and judges the list in
place: neither fans rows out nor groups them back.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.arrays import computed_once, exploded
from wardline.operators.joins import lookup_join
from wardline.operators.validators import VALIDATORS, Outcome, Params, ValidatorSet
from wardline.plans.policies import (
    DEFAULT_POLICY, REGISTRY, CheckSpec, Policy, Registry, resolve_name, resolved_guardrail,
)
from wardline.schemas import VALIDATOR_RESULT

# ---- Fixed values ---------------------------------------------------------------------------------
SUCCESS_MESSAGE = "Validation completed successfully"
FAILURE_PREFIX = "Internal error during validation: "
BATCH_CHUNK = 32
PRECHECK_MIN_LENGTH = 10
# ---- End of fixed values --------------------------------------------------------------------------

VERDICT_COLUMNS = ("resolved_guardrail", "status", "message", "valid", "validations",
                   "processed_text", "action", "skipped_validators")


def measured(df: DataFrame, names: list[str], text: str = "text",
             validators: ValidatorSet = VALIDATORS) -> DataFrame:
    """The table with the measures of the named validators, each computed once per text."""
    columns = {
        f"_{name}__{measure}": column
        for name in dict.fromkeys(names)
        for measure, column in validators[name].measure(F.col(text)).items()
    }
    return computed_once(df, columns) if columns else df


def _measures(df: DataFrame, name: str) -> dict[str, Column]:
    prefix = f"_{name}__"
    return {c.removeprefix(prefix): F.col(c) for c in df.columns if c.startswith(prefix)}


def _measure_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_") and "__" in c]


def judged(df: DataFrame, check: CheckSpec, text: str = "text",
           validators: ValidatorSet = VALIDATORS) -> Outcome:
    """Outcome of one check over a measured table."""
    params = Params(F.col(text), F.lit(check.max_length).cast("int"), F.lit(check.threshold).cast("double"))
    return _closed(check.validator, F.col(text), validators[check.validator].judge(_measures(df, check.validator), params))


def _closed(name: str, text: Column, outcome: Outcome) -> Outcome:
    """A check without a text or without an outcome, as that of a NULL score, is a failed check."""
    unknown = text.isNull() | outcome.failed.isNull()
    return replace(outcome, failed=unknown | outcome.failed,
                   message=F.when(unknown, F.lit(f"{name}: no result")).otherwise(outcome.message))


def _result(name: str, outcome: Outcome, on_fail: Column, version: str | None) -> Column:
    def or_null(column: Column | None, kind: str) -> Column:
        return (F.lit(None) if column is None else column).cast(kind)

    return F.struct(
        F.lit(name).alias("validator_name"),
        F.when(outcome.failed, F.lit("fail")).otherwise(F.lit("pass")).alias("status"),
        outcome.message.alias("message"),
        or_null(outcome.confidence, "double").alias("confidence"),
        on_fail.alias("on_fail_action"),
        or_null(outcome.entities, "array<string>").alias("entities"),
        or_null(outcome.redacted, "string").alias("redacted_text"),
        F.lit(version).cast("string").alias("model_version"),
    )


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def _route(block: Column, rewrite: Column) -> Column:
    """What a caller does with the text: block it, use the processed text, or let it pass."""
    return F.when(block, F.lit("block")).when(rewrite, F.lit("filter")).otherwise(F.lit("pass"))


def _assemble(df: DataFrame, columns: dict[str, Column], engine_error: str | None) -> DataFrame:
    """Verdict columns in place of the measures. An engine error makes the response a failure."""
    verdict = {"status": F.lit("success"), "message": F.lit(SUCCESS_MESSAGE), **columns}
    if engine_error is not None:
        broken = F.col(engine_error).isNotNull()
        instead = {
            "status": F.lit("failure"),
            "message": F.concat(F.lit(FAILURE_PREFIX), F.col(engine_error)),
            "valid": F.lit(False),
            "validations": F.array().cast(_RESULTS),
            "processed_text": F.lit(None).cast("string"),
            "action": F.lit("block"),
        }
        verdict = {name: F.when(broken, instead[name]).otherwise(column) if name in instead else column
                   for name, column in verdict.items()}
    return df.withColumns(verdict).drop(*_measure_names(df))


_RESULTS = f"array<{VALIDATOR_RESULT.simpleString()}>"


def validate(df: DataFrame, guardrail: str = DEFAULT_POLICY, text: str = "text",
             registry: Registry = REGISTRY, validators: ValidatorSet = VALIDATORS,
             engine_error: str | None = None) -> DataFrame:
    """Validate every text under one policy. Adds the verdict columns; never shuffles.

    ``validations`` holds one result per check, in policy order. ``valid`` is true when none failed,
    whatever its action. A check without a validator is listed in ``skipped_validators`` only.
    """
    policy = registry[resolve_name(guardrail, registry)]
    known = [check for check in policy.checks if check.validator in validators]
    skipped = [check.validator for check in policy.checks if check.validator not in validators]
    table = measured(df, [check.validator for check in known], text, validators)
    outcomes = [(check, judged(table, check, text, validators)) for check in known]
    results = F.array(*[_result(c.validator, o, F.lit(c.on_fail), validators[c.validator].version)
                        for c, o in outcomes]).cast(_RESULTS)
    rewritten = [F.when(o.failed, o.redacted) for _, o in reversed(outcomes) if o.redacted is not None]
    processed = F.coalesce(*rewritten) if rewritten else F.lit(None).cast("string")
    return _assemble(table, {
        "resolved_guardrail": F.lit(policy.name),
        "valid": ~_any([o.failed for _, o in outcomes]),
        "validations": results,
        "processed_text": F.nullif(processed, F.col(text)),
        "action": _route(_any([o.failed for c, o in outcomes if c.on_fail == "exception"]),
                         _any([o.failed for c, o in outcomes if c.on_fail == "filter"])),
        "skipped_validators": F.array(*[F.lit(name) for name in skipped]).cast("array<string>"),
    }, engine_error)


def _check_literal(checks: list[CheckSpec]) -> Column:
    return F.array(*[F.struct(
        F.lit(check.validator).alias("validator"),
        F.lit(check.max_length).cast("int").alias("max_length"),
        F.lit(check.threshold).cast("double").alias("threshold"),
        F.lit(check.on_fail).alias("on_fail"),
    ) for check in checks]).cast(
        "array<struct<validator:string,max_length:int,threshold:double,on_fail:string>>")


def _by_policy(registry: Registry, value, resolved: Column | None = None) -> Column:
    """A literal per policy, picked by the resolved name."""
    resolved = F.col("resolved_guardrail") if resolved is None else resolved
    chosen = value(registry[DEFAULT_POLICY])
    for policy in registry.values():
        if policy.name != DEFAULT_POLICY:
            chosen = F.when(resolved == policy.name, value(policy)).otherwise(chosen)
    return chosen


def _judge_list(df: DataFrame, text: str, validators: ValidatorSet, names: list[str],
                engine_error: str | None) -> DataFrame:
    """Judge the ``_checks`` of each row, then sum the results up."""
    table = measured(df, names, text, validators)

    def evaluate(check: Column) -> Column:
        params = Params(F.col(text), check["max_length"], check["threshold"])
        chosen = F.lit(None).cast(VALIDATOR_RESULT)
        for name in names:
            outcome = _closed(name, F.col(text), validators[name].judge(_measures(table, name), params))
            result = _result(name, outcome, check["on_fail"], validators[name].version)
            chosen = F.when(check["validator"] == name, result.cast(VALIDATOR_RESULT)).otherwise(chosen)
        return chosen

    table = table.withColumn("validations", F.transform("_checks", evaluate))
    failing = F.filter("validations", lambda r: r["status"] == "fail")
    rewritten = F.filter(failing, lambda r: r["redacted_text"].isNotNull())
    last = F.get(rewritten, F.size(rewritten) - 1)["redacted_text"]
    return _assemble(table, {
        "valid": ~F.exists("validations", lambda r: r["status"] == "fail"),
        "validations": F.col("validations"),
        "processed_text": F.nullif(last, F.col(text)),
        "action": _route(F.exists(failing, lambda r: r["on_fail_action"] == "exception"),
                         F.exists(failing, lambda r: r["on_fail_action"] == "filter")),
    }, engine_error).drop("_checks")


def validate_mixed(df: DataFrame, guardrail: str = "guardrail", text: str = "text",
                   registry: Registry = REGISTRY, validators: ValidatorSet = VALIDATORS,
                   engine_error: str | None = None) -> DataFrame:
    """Validate every text under the policy its row names; an unknown name means the default.

    The checks are literals chosen by name: no join, no fan-out, no shuffle.
    """
    names = [name for name in validators
             if any(c.validator == name for p in registry.values() for c in p.checks)]

    def known(policy: Policy) -> Column:
        return _check_literal([c for c in policy.checks if c.validator in validators])

    def skipped(policy: Policy) -> Column:
        return F.array(*[F.lit(c.validator) for c in policy.checks
                         if c.validator not in validators]).cast("array<string>")

    chosen = (df.withColumn("resolved_guardrail", resolved_guardrail(F.col(guardrail), registry))
              .withColumns({"_checks": _by_policy(registry, known),
                            "skipped_validators": _by_policy(registry, skipped)}))
    return _judge_list(chosen, text, validators, names, engine_error)


def validate_with_table(df: DataFrame, policies: DataFrame, row_id: str, guardrail: str = "guardrail",
                        text: str = "text", validators: ValidatorSet = VALIDATORS,
                        engine_error: str | None = None, registry: Registry = REGISTRY) -> DataFrame:
    """As ``validate_mixed``, with the policies in a table (one row per check), such as one per tenant.

    The table is nested to one row per policy and looked up by name: broadcast when measured small,
    else by a salted join, since one policy may serve a large share of the texts. Names it does not
    hold fall back to its ``default`` policy, and to that of the registry where it has none: no text
    goes unchecked.
    """
    # one policy's checks: bounded by the number of validators, not by the texts
    nested = policies.groupBy("guardrail").agg(F.array_sort(F.collect_list(F.struct(
        "pos", "validator", "max_length", "threshold", "on_fail"))).alias("_all"))
    default = nested.where(F.col("guardrail") == DEFAULT_POLICY).select(F.col("_all").alias("_default"))
    known_names = list(validators)
    requests = df.withColumn("_row_guardrail", F.col(guardrail))
    lookup = nested.withColumnRenamed("guardrail", "_row_guardrail").withColumn("_found", F.lit(True))
    joined = lookup_join(requests, lookup, ["_row_guardrail"], row_id)
    checks = F.col("_all")
    built_in = F.array(*[F.struct(F.lit(pos).alias("pos"), F.lit(c.validator).alias("validator"),
                                  F.lit(c.max_length).alias("max_length"), F.lit(c.threshold).alias("threshold"),
                                  F.lit(c.on_fail).alias("on_fail"))
                         for pos, c in enumerate(registry[DEFAULT_POLICY].checks)]).cast(nested.schema["_all"].dataType)
    chosen = joined.withColumn("_all", F.coalesce("_all", default.scalar(), built_in)).withColumns({
        "resolved_guardrail": F.when(F.col("_found"), F.col("_row_guardrail")).otherwise(DEFAULT_POLICY),
        "_checks": F.filter(checks, lambda c: c["validator"].isin(*known_names)),
        "skipped_validators": F.transform(
            F.filter(checks, lambda c: ~c["validator"].isin(*known_names)), lambda c: c["validator"]),
    }).drop("_all", "_found", "_row_guardrail")
    return _judge_list(chosen, text, validators, known_names, engine_error)


def validity_under(df: DataFrame, registries: dict[str, Registry], guardrail: str = "guardrail", text: str = "text",
                   validators: ValidatorSet = VALIDATORS) -> DataFrame:
    """Adds a boolean for every registry: whether the text is valid under the policy its row names there.

    Texts are measured once, however many registries judge them.
    """
    names = [name for name in validators
             if any(c.validator == name for r in registries.values() for p in r.values() for c in p.checks)]
    table = measured(df, names, text, validators)

    def fails(check: Column) -> Column:
        params = Params(F.col(text), check["max_length"], check["threshold"])
        failed = F.lit(False)
        for name in names:
            outcome = _closed(name, F.col(text), validators[name].judge(_measures(table, name), params))
            failed = F.when(check["validator"] == name, outcome.failed).otherwise(failed)
        return failed

    for column, registry in registries.items():
        resolved = resolved_guardrail(F.col(guardrail), registry)
        checks = _by_policy(registry, lambda p: _check_literal([c for c in p.checks if c.validator in validators]), resolved)
        table = table.withColumn(column, ~F.exists(checks, fails))
    return table.drop(*_measure_names(table))


def validator_results(verdicts: DataFrame, *ids: str) -> DataFrame:
    """One row per text and check: the ids, the position and the fields of the result."""
    kept = [*ids, "resolved_guardrail"]
    return (exploded(verdicts, kept, F.col("validations"), "_r", "pos")
            .select(*kept, "pos", "_r.*"))


def compare_policies(df: DataFrame, names: list[str], text: str = "text", registry: Registry = REGISTRY,
                     validators: ValidatorSet = VALIDATORS) -> DataFrame:
    """Valid texts and pass rate of the same texts under many policies.

    The texts are measured once and each policy is one conditional sum of the same pass.
    """
    specs = {name: [c for c in registry[resolve_name(name, registry)].checks if c.validator in validators]
             for name in names}
    table = measured(df, [c.validator for checks in specs.values() for c in checks], text, validators)
    sums = [F.sum((~_any([judged(table, c, text, validators).failed for c in checks])).cast("long"))
            .alias(f"v{i}") for i, checks in enumerate(specs.values())]
    totals = table.agg(F.count(F.lit(1)).alias("texts"), *sums)
    # one row wide to one row per policy
    return (totals.select("texts", F.inline(F.array(*[
                F.struct(F.lit(name).alias("guardrail"), F.coalesce(f"v{i}", F.lit(0)).alias("valid_texts"))
                for i, name in enumerate(specs)])))
            .withColumn("pass_rate", F.when(F.col("texts") > 0, F.col("valid_texts") / F.col("texts"))))


def model_info(validators: ValidatorSet = VALIDATORS) -> Column:
    """Which scorer version stands behind each validator."""
    pairs = [F.lit(part) for v in validators.values() if v.version for part in (v.name, v.version)]
    return F.create_map(*pairs)


def worth_scoring(text: Column, min_length: int = PRECHECK_MIN_LENGTH) -> Column:
    """True for texts long enough to be worth a model call."""
    return F.length(text) >= min_length


def chunk_of(pos: Column, size: int = BATCH_CHUNK) -> Column:
    return F.floor(pos / size).cast("long")


def batch_request_id(batch_id: Column, pos: Column, size: int = BATCH_CHUNK) -> Column:
    """All texts of a chunk share one request id: the batch and the chunk's first position."""
    return F.concat(F.lit("batch_"), batch_id.cast("string"), F.lit("_"),
                    (chunk_of(pos, size) * size).cast("string"))


def batch_summary(verdicts: DataFrame, *by: str) -> DataFrame:
    """Totals of a batch, or of each group of ``by``: processed, valid, cache hits and misses."""
    return verdicts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.sum(F.col("valid").cast("long")).alias("total_valid"),
        F.sum(F.col("cache_hit").cast("long")).alias("cache_hits"),
        F.sum((~F.col("cache_hit")).cast("long")).alias("cache_misses"),
    )
