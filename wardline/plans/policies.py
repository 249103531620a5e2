"""Named policies: which validators a text must pass, with their parameters and actions."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.schemas import POLICY_CHECKS

# ---- Fixed values: policies, defaults and model options, equal to the published service ----------

DEFAULT_POLICY = "default"
DEFAULT_MAX_LENGTH = 1000
ABSOLUTE_MAX_LENGTH = 10000
DEFAULT_TOXICITY_THRESHOLD = 0.7
DEFAULT_SENTIMENT_THRESHOLD = -0.5
DEFAULT_CACHE_TTL = 300

# guardrail -> (description, [(validator, max_length, threshold, on_fail), ...])
SERVICE_POLICIES = {
    "default": ("Default guardrail with basic NLP validation", [
        ("length_check", 1000, None, "exception"),
        ("toxicity_check", None, 0.7, "exception"),
        ("sentiment_check", None, -0.5, "log"),
    ]),
    "strict": ("Strict content moderation", [
        ("length_check", 500, None, "exception"),
        ("toxicity_check", None, 0.3, "exception"),
        ("sentiment_check", None, -0.3, "exception"),
        ("pii_detection", None, None, "filter"),
        ("spam_detection", None, 0.8, "exception"),
    ]),
    "permissive": ("Permissive content validation", [
        ("length_check", 2000, None, "log"),
        ("toxicity_check", None, 0.9, "log"),
    ]),
    "batch_optimized": ("Optimized for batch processing", [
        ("length_check", 1000, None, "exception"),
        ("toxicity_check", None, 0.7, "exception"),
    ]),
}

CONFIG_POLICIES = {
    "default": ("Default guardrail with basic NLP validation", [
        ("length_check", 1000, None, "exception"),
        ("toxicity_check", None, 0.7, "exception"),
        ("sentiment_check", None, -0.5, "log"),
    ]),
    "strict": ("Strict content moderation for sensitive applications", [
        ("length_check", 500, None, "exception"),
        ("toxicity_check", None, 0.3, "exception"),
        ("sentiment_check", None, -0.3, "exception"),
        ("pii_detection", None, None, "filter"),
    ]),
    "permissive": ("Permissive content validation for open platforms", [
        ("length_check", 2000, None, "log"),
        ("toxicity_check", None, 0.9, "log"),
    ]),
    "content_moderation": ("Comprehensive content moderation", [
        ("length_check", 1500, None, "exception"),
        ("toxicity_check", None, 0.5, "exception"),
        ("sentiment_check", None, -0.4, "log"),
        ("pii_detection", None, None, "filter"),
    ]),
    "customer_service": ("Guardrails for customer service applications", [
        ("length_check", 3000, None, "exception"),
        ("toxicity_check", None, 0.6, "log"),
        ("sentiment_check", None, -0.6, "log"),
        ("pii_detection", None, None, "filter"),
    ]),
}

MODEL_OPTIONS = {
    "toxicity_check": [
        "unitary/toxic-bert",
        "facebook/roberta-hate-speech-dynabench-r4-target",
        "microsoft/DialoGPT-medium",
    ],
    "sentiment_check": [
        "cardiffnlp/twitter-roberta-base-sentiment-latest",
        "nlptown/bert-base-multilingual-uncased-sentiment",
        "distilbert-base-uncased-finetuned-sst-2-english",
    ],
    "pii_detection": ["en_core_web_sm", "en_core_web_md", "en_core_web_lg"],
}

ON_FAIL_ACTIONS = ("exception", "filter", "reask", "log", "warn")

# ---- End of fixed values --------------------------------------------------------------------------


@dataclass(frozen=True)
class CheckSpec:
    """One validator of a policy."""

    validator: str
    max_length: int | None = None
    threshold: float | None = None
    on_fail: str = "exception"

    def __post_init__(self) -> None:
        if self.on_fail not in ON_FAIL_ACTIONS:
            raise ValueError(f"unknown on_fail action {self.on_fail!r}")


@dataclass(frozen=True)
class Policy:
    """A named, ordered list of checks. ``version`` changes whenever a check does."""

    name: str
    description: str
    checks: tuple[CheckSpec, ...]

    @property
    def version(self) -> str:
        body = json.dumps([asdict(check) for check in self.checks], sort_keys=True)
        return hashlib.md5(body.encode()).hexdigest()[:8]


Registry = dict[str, Policy]


def registry_from(table: dict) -> Registry:
    return {
        name: Policy(name, description, tuple(CheckSpec(*check) for check in checks))
        for name, (description, checks) in table.items()
    }


def merge_registries(first: Registry, second: Registry) -> Registry:
    """All names of both; where both define a name, ``first`` wins."""
    return {**second, **first}


SERVICE = registry_from(SERVICE_POLICIES)
CONFIG = registry_from(CONFIG_POLICIES)
REGISTRY = merge_registries(SERVICE, CONFIG)


def resolve_name(name: str, registry: Registry = REGISTRY) -> str:
    return name if name in registry else DEFAULT_POLICY


def resolved_guardrail(requested: Column, registry: Registry = REGISTRY) -> Column:
    """The requested name where the registry has it, else the default policy."""
    return F.when(requested.isin(*registry), requested).otherwise(F.lit(DEFAULT_POLICY))


def policy_version(resolved: Column, registry: Registry = REGISTRY) -> Column:
    """Version of a resolved policy, so that results of an older definition are never reused."""
    value = F.lit(registry[DEFAULT_POLICY].version)
    for policy in registry.values():
        value = F.when(resolved == policy.name, F.lit(policy.version)).otherwise(value)
    return value


def cap_lengths(registry: Registry, cap: int = ABSOLUTE_MAX_LENGTH) -> Registry:
    """The registry with every length limit lowered to the absolute cap."""
    def lowered(check: CheckSpec) -> CheckSpec:
        if check.validator != "length_check":
            return check
        limit = DEFAULT_MAX_LENGTH if check.max_length is None else check.max_length
        return CheckSpec(check.validator, min(limit, cap), check.threshold, check.on_fail)

    return {
        policy.name: Policy(policy.name, policy.description, tuple(map(lowered, policy.checks)))
        for policy in registry.values()
    }


def policy_rows(spark: SparkSession, registry: Registry = REGISTRY) -> DataFrame:
    """The registry as a long table, one row per policy and check."""
    rows = [
        (policy.name, pos, check.validator, check.max_length, check.threshold, check.on_fail)
        for policy in registry.values()
        for pos, check in enumerate(policy.checks)
    ]
    return spark.createDataFrame(rows, POLICY_CHECKS)


def policy_summary(spark: SparkSession, registry: Registry, models: dict[str, str]) -> DataFrame:
    """One row per policy: description, number of checks, their names and their loaded models in order."""
    rows = [
        (p.name, p.description, len(p.checks), ",".join(c.validator for c in p.checks),
         ",".join(models[c.validator] for c in p.checks if c.validator in models))
        for p in registry.values()
    ]
    return spark.createDataFrame(
        rows, "guardrail string, description string, n_validators int, validators string, models string")


def model_options(spark: SparkSession) -> DataFrame:
    """The models each validator can be backed by, as a table to choose plug-ins from."""
    rows = [(validator, model) for validator, models in MODEL_OPTIONS.items() for model in models]
    return spark.createDataFrame(rows, "validator string, model string")


def registry_sides(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two registries side by side: one row per policy and check that either has.

    Both are tables of ``policy_rows``; the join is null-safe, so a policy without a name stays one. ``first_`` and
    ``second_`` columns hold the parameters, NULL where a registry lacks the check; ``winner`` is the registry whose
    policy counts: the first where it has the policy at all, with or without this check.
    """
    parameters = [c for c in POLICY_CHECKS.fieldNames() if c not in ("guardrail", "validator")]

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"{name}_{c}") for c in rows.columns], F.lit(True).alias(f"in_{name}"))

    left, right = side(first, "first"), side(second, "second")
    same = (F.col("first_guardrail").eqNullSafe(F.col("second_guardrail"))
            & F.col("first_validator").eqNullSafe(F.col("second_validator")))
    joined = left.join(right, same, "full")
    chosen = {c: F.when(F.col("in_first"), F.col(f"first_{c}")).otherwise(F.col(f"second_{c}"))
              for c in ("guardrail", "validator")}
    has = first.select(F.col("guardrail").alias("_owner"), F.lit(True).alias("_owned")).distinct()
    owned = joined.withColumns(chosen)
    owned = owned.join(has, owned["guardrail"].eqNullSafe(has["_owner"]), "left")
    return owned.select(
        "guardrail", "validator", *[f"{side}_{c}" for c in parameters for side in ("first", "second")],
        F.coalesce("in_first", F.lit(False)).alias("in_first"), F.coalesce("in_second", F.lit(False)).alias("in_second"),
        F.when(F.col("_owned"), "first").otherwise("second").alias("winner"))


def registry_merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """The checks of both registries; where both define a policy, that of the first counts as a whole."""
    sides = registry_sides(first, second)
    parameters = [c for c in POLICY_CHECKS.fieldNames() if c not in ("guardrail", "validator")]
    of_first = F.col("winner") == "first"
    return (sides.where(F.when(of_first, F.col("in_first")).otherwise(F.col("in_second")))
            .select("guardrail", "validator", "winner", *[
                F.when(of_first, F.col(f"first_{c}")).otherwise(F.col(f"second_{c}")).alias(c) for c in parameters]))


def registry_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Checks that only one registry has, or that both have with other parameters, and which parameters differ."""
    sides = registry_sides(first, second)
    differing = F.concat_ws(",", *[F.when(~F.col(f"first_{c}").eqNullSafe(F.col(f"second_{c}")), F.lit(c))
                                   for c in ("max_length", "threshold", "on_fail")])
    kind = (F.when(~F.col("in_second"), "first only").when(~F.col("in_first"), "second only")
            .when(differing != "", F.concat(F.lit("differs: "), differing)))
    return sides.select("guardrail", "validator", "winner", kind.alias("drift")).where(F.col("drift").isNotNull())


def registry_drift(spark: SparkSession, first: Registry = SERVICE, second: Registry = CONFIG) -> DataFrame:
    """Checks that only one registry has, or that both have with other parameters, as they stand there."""
    left, right = policy_rows(spark, first), policy_rows(spark, second)
    return (left.exceptAll(right).withColumn("only_in", F.lit("first"))
            .unionByName(right.exceptAll(left).withColumn("only_in", F.lit("second"))))
