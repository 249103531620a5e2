"""Alert thresholds and health tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import fixed3

# ---- Fixed values ---------------------------------------------------------------------------------
# metric -> (threshold, side on which it alerts)
ALERT_THRESHOLDS = {
    "response_time_p95": (5.0, "above"),
    "error_rate": (0.05, "above"),
    "memory_usage": (0.9, "above"),
    "cpu_usage": (0.9, "above"),
    "cache_hit_ratio": (0.7, "below"),
}
MAX_MEMORY_PERCENT, MAX_CPU_PERCENT = 90, 90
MEMORY_ERROR = "High memory usage detected"
CPU_ERROR = "High CPU usage detected"
CACHE_ERROR = "Cache connection failed"
UNHEALTHY_ERRORS = 3
# ---- End of fixed values --------------------------------------------------------------------------


def _by_metric(metric: Column, position: int, kind: str) -> Column:
    chosen = F.lit(None).cast(kind)
    for name, rule in ALERT_THRESHOLDS.items():
        chosen = F.when(metric == name, F.lit(rule[position])).otherwise(chosen)
    return chosen


def alerts(values: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Metric values beyond their threshold, with a message. Fractions, not percentages."""
    limit = _by_metric(F.col(metric), 0, "double")
    side = _by_metric(F.col(metric), 1, "string")
    over = (side == "above") & (F.col(value) > limit)
    under = (side == "below") & (F.col(value) < limit)
    message = F.concat(F.col(metric),
                       F.when(side == "above", " exceeded threshold: ").otherwise(" fell below threshold: "),
                       fixed3(F.col(value)), F.when(side == "above", " > ").otherwise(" < "),
                       limit.cast("string"))
    return values.where(over | under).withColumn("threshold", limit).withColumn("message", message)


def unpivot_metrics(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """One row per metric value; metrics without a value are left out."""
    return wide.unpivot(ids, metrics, "metric", "value").where(F.col("value").isNotNull())


def health_errors(memory_percent: Column, cpu_percent: Column, cache_up: Column) -> Column:
    """The error messages of a health check, joined by ``;``."""
    return F.concat_ws(";", F.when(memory_percent > MAX_MEMORY_PERCENT, MEMORY_ERROR),
                       F.when(cpu_percent > MAX_CPU_PERCENT, CPU_ERROR),
                       F.when(~cache_up, CACHE_ERROR))


def health_tier(n_errors: Column) -> Column:
    return (F.when(n_errors == 0, "healthy").when(n_errors < UNHEALTHY_ERRORS, "degraded")
            .otherwise("unhealthy"))
