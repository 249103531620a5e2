"""Counters, histograms, gauges and rates over request logs and verdicts.

Every metric is a mergeable aggregate: partial results are formed before the shuffle, so a label that
covers most rows costs one row per task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.arrays import exploded
from wardline.operators.quantiles import exact_quantiles
from wardline.operators.slices import running_sum

# ---- Fixed values: histogram bucket bounds in seconds ---------------------------------------------
REQUEST_BUCKETS = [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]
VALIDATION_BUCKETS = [0.01, 0.05, 0.1, 0.5, 1.0, 2.5, 5.0]
INFERENCE_BUCKETS = [0.01, 0.05, 0.1, 0.5, 1.0, 2.5, 5.0, 10.0]
MODEL_LOAD_BUCKETS = [1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]
# ---- End of fixed values --------------------------------------------------------------------------

MEDIUM_CONFIDENCE, HIGH_CONFIDENCE = 0.5, 0.8


def exact_sum(value: Column) -> Column:
    """Sum of a measurement that does not depend on the order of the rows: in decimals of nano units."""
    return F.sum(value.cast("decimal(28,9)")).cast("double")


def position(at: Column, row_id: Column) -> Column:
    """Place of a row in a log: by time, then by id, as one decimal.

    A struct would say the same, but an aggregate ordered by a struct sorts its rows, while one ordered
    by a decimal keeps a hash table.
    """
    return at.cast("decimal(19,0)") * F.lit(Decimal(10 ** 19)) + row_id.cast("decimal(19,0)")


def counter(df: DataFrame, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, buckets: list[float], *labels: str) -> DataFrame:
    """Cumulative buckets, one row per label set and bound, ``+Inf`` included.

    All buckets are counted in one pass as conditional counts; no row is multiplied.
    """
    column = F.col(value)
    counted = df.groupBy(*labels).agg(
        *[F.count(F.when(column <= bound, 1)).alias(f"_b{i}") for i, bound in enumerate(buckets)],
        F.count(column).alias("observations"), exact_sum(column).alias("total"))
    bounds = [F.struct(F.lit(str(bound)).alias("le"), F.col(f"_b{i}").alias("cumulative"))
              for i, bound in enumerate(buckets)]
    bounds.append(F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("cumulative")))
    return counted.select(*labels, F.inline(F.array(*bounds)), "observations", "total")


def hit_ratio(hits: Column, misses: Column) -> Column:
    """Share of hits; undefined without any operation."""
    return F.when(hits + misses > 0, hits / (hits + misses))


def error_rate(failed: Column) -> Column:
    return F.avg(F.when(failed, 1.0).otherwise(0.0))


def last_values(samples: DataFrame, value: str, ts: str, tie: str, *labels: str) -> DataFrame:
    """The newest value of a gauge per label set; ``ts`` and ``tie`` are integers."""
    return samples.groupBy(*labels).agg(F.max_by(value, position(F.col(ts), F.col(tie))).alias("value"))


def connection_load(requests: DataFrame, start: str, end: str, *labels: str, slice_seconds: int = 3600) -> DataFrame:
    """Open connections at the end of each second in which their number changes.

    Starts add one and ends take one off. Both are netted per second first, and the running total is carried
    from slice to slice, so the seconds of one label are dealt to many tasks.
    """
    changes = F.array(F.struct(F.col(start).alias("second"), F.lit(1).alias("change")),
                      F.struct(F.col(end).alias("second"), F.lit(-1).alias("change")))
    net = (requests.select(*labels, F.inline(changes))
           .groupBy(*labels, "second").agg(F.sum("change").alias("net")))
    return running_sum(net, list(labels), "second", "net", "active", slice_seconds)


def confidence_level(score: Column) -> Column:
    return (F.when(score < MEDIUM_CONFIDENCE, "low").when(score < HIGH_CONFIDENCE, "medium")
            .otherwise("high"))


def toxicity_levels(scores: DataFrame, score: str = "score", *labels: str) -> DataFrame:
    """Toxic texts by level of confidence."""
    return counter(scores.where(F.col(score) > 0)
                   .withColumn("confidence_level", confidence_level(F.col(score))),
                   *labels, "confidence_level")


def pii_by_type(texts: DataFrame, entities: str = "entities") -> DataFrame:
    """Entities by label."""
    labels = exploded(texts, [], F.col(entities), "_e").select(
        F.substring_index("_e", ":", 1).alias("entity_type"))
    return counter(labels, "entity_type")


def texts_processed(verdicts: DataFrame) -> DataFrame:
    result = F.when(F.col("valid"), "valid").otherwise("invalid")
    return counter(verdicts.withColumn("result", result), "resolved_guardrail", "result")


def policy_rollup(results: DataFrame) -> DataFrame:
    """Checks and failures per policy and validator, per policy, and in total."""
    return (results.rollup("resolved_guardrail", "validator_name")
            .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("checks"),
                 F.count(F.when(F.col("status") == "fail", 1)).alias("failures")))


def latency_stats(requests: DataFrame, value: str, ts_seconds: str, *labels: str) -> DataFrame:
    """Requests, mean, p95, p99 and requests per second of the span between first and last."""
    basic = requests.groupBy(*labels).agg(
        F.count(F.lit(1)).alias("requests"),
        (exact_sum(F.col(value)) / F.count(value)).alias("mean"),
        (F.max(ts_seconds) - F.min(ts_seconds)).alias("_span"))
    tails = exact_quantiles(requests, list(labels), value, [0.95, 0.99])
    wide = tails.groupBy(*labels).agg(
        F.max(F.when(F.col("probability") == 0.95, F.col("quantile"))).alias("p95"),
        F.max(F.when(F.col("probability") == 0.99, F.col("quantile"))).alias("p99"))
    return (basic.join(wide, list(labels), "left")
            .withColumn("throughput", F.when(F.col("_span") > 0, F.col("requests") / F.col("_span")))
            .drop("_span"))


def windowed(df: DataFrame, ts: str, width: str, value: str, *labels: str) -> DataFrame:
    """Count and sum per tumbling window; the same call serves a stream with a watermark."""
    return (df.groupBy(F.window(ts, width).alias("w"), *labels)
            .agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col(value)).alias("total"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *labels, "n", "total"))


def sessions(df: DataFrame, user: str, ts_micros: str, gap_seconds: int = 1800) -> DataFrame:
    """Activity sessions: a pause longer than the gap ends one.

    Requests are first merged into slices of half the gap, in which no session can end. The sessions
    are then found among the slices, so a user with most of the traffic is a few rows per hour.
    """
    gap = gap_seconds * 1_000_000
    slices = (df.groupBy(user, F.floor(F.col(ts_micros) / (gap // 2)).alias("_slice"))
              .agg(F.min(ts_micros).alias("_first"), F.max(ts_micros).alias("_last"),
                   F.count(F.lit(1)).alias("_n")))
    order = Window.partitionBy(user).orderBy("_slice")
    fresh = F.when(F.col("_first") - F.lag("_last").over(order) <= gap, 0).otherwise(1)
    return (slices.withColumn("_fresh", fresh)
            .withColumn("session", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(user, "session")
            .agg(F.min("_first").alias("first_micros"), F.max("_last").alias("last_micros"),
                 F.sum("_n").alias("requests")))
