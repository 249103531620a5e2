"""Chat turns: pairing, turn safety, input and output gates, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import safety
from wardline.operators.engine import validate
from wardline.operators.validators import VALIDATORS, ValidatorSet
from wardline.plans.policies import DEFAULT_POLICY, REGISTRY, Registry

# ---- Fixed values ---------------------------------------------------------------------------------
INPUT_BLOCKED = "Your message contains content that violates our guidelines."
OUTPUT_BLOCKED = ("I apologize, but I cannot provide a response that meets our content guidelines. "
                  "Please try rephrasing your question.")
USER_CONTEXT, REPLY_CONTEXT = "user_input", "ai_output"
# ---- End of fixed values --------------------------------------------------------------------------


SLICE_TURNS = 1_000  # turn numbers that one task looks at together


def following(turns: DataFrame, *columns: str, slice_turns: int = SLICE_TURNS) -> DataFrame:
    """Each turn with ``next``: number and ``columns`` of the turn that follows it in its conversation.

    Turn numbers may have holes. They are cut into slices, so that a conversation of any length is spread
    over tasks; the last turn of a slice gets the first one of the next slice that has any.
    """
    sliced = turns.withColumns({"_slice": F.floor(F.col("turn") / slice_turns),
                                "_turn": F.struct("turn", *columns)})
    within = Window.partitionBy("conv_id", "_slice").orderBy("turn")
    first = sliced.groupBy("conv_id", "_slice").agg(F.min_by("_turn", "turn").alias("_first"))
    later = Window.partitionBy("conv_id").orderBy("_slice")
    crossing = (first.select("conv_id", "_slice", F.lead("_first").over(later).alias("_crossing"))
                .where(F.col("_crossing").isNotNull()))
    return (sliced.withColumn("_within", F.lead("_turn").over(within))
            .join(crossing, ["conv_id", "_slice"], "left")
            .withColumn("next", F.coalesce("_within", "_crossing"))
            .drop("_slice", "_turn", "_within", "_crossing"))


def turn_pairs(turns: DataFrame) -> DataFrame:
    """User turns directly followed by a reply."""
    return (following(turns.select("conv_id", "turn", "role", "text"), "role", "text")
            .where((F.col("role") == "user") & (F.col("next.role") == "assistant"))
            .select("conv_id", "turn", F.col("text").alias("user_text"), F.col("next.turn").alias("reply_turn"),
                    F.col("next.text").alias("reply_text")))


def turn_safety(turns: DataFrame) -> DataFrame:
    """Whether the user text, the reply and the turn as a whole are safe.

    Texts are classified before they are paired, so only flags are shuffled.
    """
    context = F.when(F.col("role") == "user", USER_CONTEXT).otherwise(REPLY_CONTEXT)
    classified = (turns.select("conv_id", "turn", "role",
                               safety.keyword_verdict(safety.prompt(F.col("text"), context)).alias("_raw"))
                  .select("conv_id", "turn", "role", safety.says_safe(F.col("_raw")).alias("is_safe")))
    return (following(classified, "role", "is_safe")
            .where((F.col("role") == "user") & (F.col("next.role") == "assistant"))
            .select("conv_id", "turn", F.col("is_safe").alias("user_input_safe"), F.col("next.turn").alias("reply_turn"),
                    F.col("next.is_safe").alias("ai_output_safe"))
            .withColumn("conversation_safe", F.col("user_input_safe") & F.col("ai_output_safe")))


def only_safe(df: DataFrame, flag: str = "is_safe") -> DataFrame:
    """Rows known to be safe; a missing verdict is not safe."""
    return df.where(F.coalesce(F.col(flag), F.lit(False)))


def gate(verdicts: DataFrame, text: str = "text", fail_open: bool = False) -> DataFrame:
    """Adds ``blocked`` and ``gated_text`` to verdicts.

    A failing check of action ``exception`` blocks. Else the processed text goes on, or the text
    itself. When the service failed, the gate closes unless ``fail_open``.
    """
    failed = F.col("status") == "failure"
    blocked = F.when(failed, F.lit(not fail_open)).otherwise(F.col("action") == "block")
    return (verdicts.withColumn("blocked", blocked)
            .withColumn("gated_text", F.coalesce("processed_text", text)))


def turn_outcomes(turns: DataFrame, guardrail: str = DEFAULT_POLICY, registry: Registry = REGISTRY,
                  validators: ValidatorSet = VALIDATORS, fail_open: bool = False) -> DataFrame:
    """Each user turn through both gates: blocked at the input, at the output, or delivered.

    A user turn without a reply has no outcome yet unless it was blocked.
    """
    gated = gate(validate(turns, guardrail, registry=registry, validators=validators), fail_open=fail_open)
    reply = F.when(F.col("next.role") == "assistant", F.col("next"))
    paired = (following(gated.select("conv_id", "turn", "role", "blocked", "gated_text"), "role", "blocked", "gated_text")
              .where(F.col("role") == "user")
              .select("conv_id", "turn", F.col("blocked").alias("input_blocked"), reply.alias("_r"))
              .select("conv_id", "turn", "input_blocked", F.col("_r.turn").alias("reply_turn"),
                      F.col("_r.blocked").alias("output_blocked"), F.col("_r.gated_text").alias("_reply")))
    outcome = (F.when(F.col("input_blocked"), "blocked_input")
               .when(F.col("reply_turn").isNull(), "unanswered")
               .when(F.col("output_blocked"), "blocked_output")
               .otherwise("delivered"))
    return (paired.withColumn("outcome", outcome)
            .withColumn("response", F.when(F.col("outcome") == "blocked_input", F.lit(INPUT_BLOCKED))
                        .when(F.col("outcome") == "blocked_output", F.lit(OUTPUT_BLOCKED))
                        .when(F.col("outcome") == "delivered", F.col("_reply")))
            .drop("_reply"))


def request_context(user_id: Column, session_id: Column) -> Column:
    """The context map of a chat request: only ids that are set and not empty."""
    pairs = F.create_map(F.lit("user_id"), user_id, F.lit("session_id"), session_id)
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))


def conversation_rollup(outcomes: DataFrame) -> DataFrame:
    """Per conversation: user turns, how they ended, and whether none was blocked."""
    def ended(name: str) -> Column:
        return F.count(F.when(F.col("outcome") == name, 1))

    return outcomes.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("user_turns"),
        ended("blocked_input").alias("blocked_inputs"),
        ended("blocked_output").alias("blocked_outputs"),
        ended("delivered").alias("delivered"),
        F.bool_and(~F.col("outcome").isin("blocked_input", "blocked_output")).alias("clean"))


def gap_counts(turns: DataFrame) -> DataFrame:
    """Per conversation, how many turn numbers between its first and its last are missing."""
    return turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("missing"))


def missing_turns(turns: DataFrame) -> DataFrame:
    """Conversations whose turn numbers have holes, where a reply may lack its question."""
    return gap_counts(turns).where(F.col("missing") != 0)
