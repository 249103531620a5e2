"""Admission: which requests are accepted, and why the others are not.

Every rule is a column expression on the request row, so one pass yields both the accepted rows and
the quarantine. Lengths are checked before the text is stripped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import stripped
from wardline.plans.policies import DEFAULT_CACHE_TTL

# ---- Fixed values ---------------------------------------------------------------------------------
MIN_TEXT_LENGTH, MAX_TEXT_LENGTH = 1, 50000
MIN_BATCH, MAX_BATCH = 1, 100
MIN_TTL, MAX_TTL = 0, 3600
# ---- End of fixed values --------------------------------------------------------------------------


def effective_ttl(ttl: Column) -> Column:
    return F.coalesce(ttl, F.lit(DEFAULT_CACHE_TTL))


def reject_reason(text: Column, ttl: Column | None = None, batch_size: Column | None = None) -> Column:
    """The first rule a request breaks; NULL for an accepted request."""
    length = F.length(text)
    reason = (F.when(text.isNull(), "missing_text")
              .when(length < MIN_TEXT_LENGTH, "empty_text")
              .when(length > MAX_TEXT_LENGTH, "text_too_long")
              .when(F.length(stripped(text)) == 0, "blank_text"))
    if ttl is not None:
        reason = reason.when(~effective_ttl(ttl).between(MIN_TTL, MAX_TTL), "ttl_out_of_range")
    if batch_size is not None:
        reason = reason.when(~batch_size.between(MIN_BATCH, MAX_BATCH), "batch_size_out_of_range")
    return reason


def screened(df: DataFrame, text: str = "text", ttl: str | None = None,
             batch_size: str | None = None) -> DataFrame:
    """The requests with ``reject_reason`` and, where accepted, the stripped text."""
    reason = reject_reason(F.col(text), F.col(ttl) if ttl else None,
                           F.col(batch_size) if batch_size else None)
    return (df.withColumn("reject_reason", reason)
            .withColumn(text, F.when(F.col("reject_reason").isNull(), stripped(F.col(text)))
                        .otherwise(F.col(text))))


def accepted(screened_df: DataFrame) -> DataFrame:
    return screened_df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantined(screened_df: DataFrame) -> DataFrame:
    return screened_df.where(F.col("reject_reason").isNotNull())


def batch_sizes(df: DataFrame, batch_id: str = "batch_id") -> DataFrame:
    """Texts per batch and whether the size is allowed. Partial counts keep a hot batch harmless."""
    return (df.groupBy(batch_id).agg(F.count(F.lit(1)).alias("n_texts"))
            .withColumn("accepted", F.col("n_texts").between(MIN_BATCH, MAX_BATCH)))


def sound_result() -> Column:
    """Whether a validator result keeps its contract; a field that is missing breaks it."""
    from wardline.plans.policies import ON_FAIL_ACTIONS

    sound = (F.col("status").isin("pass", "fail")
             & F.col("on_fail_action").isin(*ON_FAIL_ACTIONS)
             & F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(True)))
    return F.coalesce(sound, F.lit(False))


def broken_results(results: DataFrame) -> DataFrame:
    """Validator results outside their contract; sound data gives no row."""
    return results.where(~sound_result())
