"""Writers for verdicts, check results, store entries, metrics, spans and the audit trail.

All are partitioned Parquet. A rewritten table is written next to the old one: readers switch paths,
so a lost executor or a failed job never leaves a half-written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _write(df: DataFrame, path: str, mode: str, by: str) -> None:
    """Write one folder per value of ``by``, in files of the advisory partition size.

    The rebalance hint gathers small values and splits a large one, so neither a flood of small files
    nor one task for a hot value comes of it.
    """
    df.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)


def write_verdicts(verdicts: DataFrame, path: str, mode: str = "append") -> None:
    """Verdicts by policy."""
    _write(verdicts, path, mode, "resolved_guardrail")


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """Check results (one row per text and check) by validator."""
    _write(results, path, mode, "validator_name")


def write_store(entries: DataFrame, path: str, mode: str = "append") -> None:
    """Result-store entries by day of expiry, so that reads skip the dead days."""
    _write(entries, path, mode, "expires_on")


def read_store(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Store entries alive at ``as_of``; days that ended before are pruned by partition."""
    return (spark.read.parquet(path)
            .where((F.col("expires_on") >= F.to_date(as_of)) & (F.col("expires_at") > as_of)))


def write_bucketed_store(entries: DataFrame, table: str, path: str, buckets: int = 64, key: str = "cache_key") -> DataFrame:
    """The store as a table bucketed by key with the newest entry of each key; probes do not shuffle it.

    Entries of a key are reduced within tasks before they meet. Choose ``buckets`` so that one fits a task: about
    one for every 128 MB of the store.
    """
    others = [c for c in entries.columns if c not in (key, "written_at")]
    newest = (entries.groupBy(key).agg(F.max(F.struct("written_at", *others)).alias("_entry")).select(key, "_entry.*"))
    (newest.repartition(buckets, key).write.mode("overwrite").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return entries.sparkSession.table(table)


def write_metrics(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Metric samples (``metric, labels, le, value, window_start``) by metric."""
    _write(samples, path, mode, "metric")


def write_sketches(sketches: DataFrame, path: str, mode: str = "append") -> None:
    """Quantile sketches by day, so that a period reads its days only."""
    _write(sketches, path, mode, "day")


def write_spans(spans: DataFrame, path: str, mode: str = "append") -> None:
    spans.write.mode(mode).parquet(path)


def append_audit(results: DataFrame, path: str, day: str = "audit_date") -> None:
    """Audit trail of check results by day."""
    _write(results, path, "append", day)


def retain_audit(spark: SparkSession, path: str, target: str, first_day: Column,
                 day: str = "audit_date") -> DataFrame:
    """Rewrite the audit trail to ``target`` without the days before ``first_day``; whole days are pruned."""
    _write(spark.read.parquet(path).where(F.col(day) >= first_day), target, "overwrite", day)
    return spark.read.parquet(target)
