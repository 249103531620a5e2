"""One path for a request: admission, result store, validation, response, and what is written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.arrays import exploded
from wardline.operators import admission, cache, engine
from wardline.operators.validators import VALIDATORS, ValidatorSet
from wardline.plans.policies import REGISTRY, Registry, policy_version, resolved_guardrail

# ---- Fixed values ---------------------------------------------------------------------------------
REJECTED_PREFIX = "Invalid request: "
# ---- End of fixed values --------------------------------------------------------------------------

RESULTS = ["resolved_guardrail", "status", "message", "valid", "validations", "processed_text", "action"]


def admitted(requests: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Requests with ``reject_reason``, the policy they get, and the key of their result."""
    screened = admission.screened(requests, ttl="cache_ttl")
    resolved = resolved_guardrail(F.col("guardrail"), registry)
    return (screened.withColumn("resolved", resolved)
            .withColumn("cache_key", cache.cache_key(F.col("text"), F.col("resolved"),
                                                     policy_version(F.col("resolved"), registry)))
            .withColumn("skip_cache", F.coalesce("skip_cache", F.lit(False))))


def scorer(registry: Registry = REGISTRY, validators: ValidatorSet = VALIDATORS):
    """Adds the result columns to rows with ``text`` and ``resolved``, each under its own policy."""
    def score(df: DataFrame) -> DataFrame:
        judged = engine.validate_mixed(df, "resolved", registry=registry, validators=validators)
        return judged.select(*df.columns, *RESULTS)
    return score


def model_versions(validations: Column) -> Column:
    """The scorer versions behind a result, by check."""
    named = F.filter(validations, lambda v: v["model_version"].isNotNull())
    return F.map_from_entries(F.transform(named, lambda v: F.struct(v["validator_name"], v["model_version"])))


def answer(requests: DataFrame, live: DataFrame, row_id: str = "request_id", registry: Registry = REGISTRY,
           validators: ValidatorSet = VALIDATORS) -> DataFrame:
    """The whole response of every request, one row each.

    A request that breaks a rule of admission is answered as a failure with the rule as message. The others
    are answered from live store entries (``cache_key`` and the result columns) or validated, each different
    text and policy once; ``skip_cache`` goes past the store. A response holds the request id, the verdict,
    the scorer versions, whether it came from the store and the lifetime its entry gets.
    """
    rows = admitted(requests, registry)
    accepted = admission.accepted(rows)
    answers = cache.validate_through_store(
        accepted.select(row_id, "text", "resolved", "cache_key", "skip_cache"), live,
        scorer(registry, validators), row_id, bypass="skip_cache")
    facts = accepted.select(row_id, "skip_cache", admission.effective_ttl(F.col("cache_ttl")).alias("ttl"))
    answered = (facts.join(answers, row_id).withColumn("reject_reason", F.lit(None).cast("string"))
                .withColumn("model_info", model_versions(F.col("validations"))))
    turned_away = admission.quarantined(rows).select(
        row_id, "skip_cache", "reject_reason", F.col("resolved").alias("resolved_guardrail"),
        F.lit("failure").alias("status"), F.concat(F.lit(REJECTED_PREFIX), F.col("reject_reason")).alias("message"),
        F.lit(False).alias("valid"), F.lit("block").alias("action"), F.lit(False).alias("cache_hit"))
    return answered.unionByName(turned_away, allowMissingColumns=True)


def entries(responses: DataFrame, written_at: Column, row_id: str = "request_id") -> DataFrame:
    """Store rows of the newly validated results, alive for as long as their request asked.

    Requests past the store write nothing; a lifetime of zero is not worth an entry.
    """
    fresh = responses.where(F.col("reject_reason").isNull() & ~F.col("cache_hit") & ~F.col("skip_cache")
                            & (F.col("ttl") > 0))
    return cache.store_entries(fresh.select("cache_key", "ttl", *RESULTS), written_at, F.col("ttl")).drop("ttl")


def batch_responses(responses: DataFrame, batch_id: str = "batch_id") -> DataFrame:
    """Totals per batch: texts, valid ones, and where the answers came from."""
    return engine.batch_summary(responses, batch_id)


def answer_batches(batches: DataFrame, live: DataFrame, batch_id: str = "batch_id", registry: Registry = REGISTRY,
                   validators: ValidatorSet = VALIDATORS) -> DataFrame:
    """The response of every batch request, one row each: status, message, totals and ``results`` in the order of the texts.

    ``batches`` has the id, ``texts`` and the options of a request, which hold for all its texts. A batch of no text or
    too many is a failure as a whole and none of its texts is validated. The texts of the others are answered as
    single requests are, equal ones of all batches once; a text that breaks a rule is a result that is not valid. A
    result list is bounded by the size of a batch.
    """
    sized = batches.withColumn("_n", F.coalesce(F.size("texts"), F.lit(0)))
    fits = F.col("_n").between(admission.MIN_BATCH, admission.MAX_BATCH)
    options = [c for c in ("guardrail", "cache_ttl", "skip_cache") if c in batches.columns]
    texts = exploded(sized.where(fits), [batch_id, *options], F.col("texts"), "text", "pos")
    asking = texts.select(F.struct(F.col(batch_id).alias("batch"), "pos").alias("_text_id"), "text", *options)
    answered = answer(asking, live, "_text_id", registry, validators)
    result = F.struct(F.col("_text_id.pos").alias("pos"), "valid", "action", "cache_hit", "reject_reason", "processed_text")
    listed = answered.groupBy(F.col("_text_id.batch").alias("_batch")).agg(F.array_sort(F.collect_list(result)).alias("results"))
    totals = batch_responses(answered.withColumn("_batch", F.col("_text_id.batch")), "_batch")
    done = totals.join(listed, "_batch").select(
        F.col("_batch").alias(batch_id), F.lit("success").alias("status"),
        F.concat(F.lit("Batch validation completed: "), F.col("total_processed"), F.lit(" texts processed")).alias("message"),
        "total_processed", "total_valid", "cache_hits", "cache_misses", "results")
    broken = sized.where(~fits).select(
        batch_id, F.lit("failure").alias("status"), F.concat(F.lit(REJECTED_PREFIX), F.lit("batch_size")).alias("message"))
    return done.unionByName(broken, allowMissingColumns=True)
