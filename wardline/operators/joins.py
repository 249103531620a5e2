"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table is within the broadcast bound, measured by one aggregate over it."""
    width = F.lit(16 * len(df.columns))
    for name in df.columns:
        width = width + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return row["n"] <= max_rows and row["b"] <= max_bytes


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], row_id: str, how: str = "left",
                max_rows: int = BROADCAST_ROWS, hot_rows: int = 1_000_000) -> DataFrame:
    """Join to a lookup table whose size is not known beforehand.

    Measured small, the lookup is broadcast. Else both sides are shuffled, and keys with many rows on the
    left are salted by their measured number of rows.
    """
    if is_small(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, row_id, how, hot_rows)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], row_id: str, how: str = "left",
                hot_rows: int = 1_000_000) -> DataFrame:
    """A join that deals every key with at least ``hot_rows`` rows on the left to as many tasks as it needs.

    Keys are counted, combined within each task first. A hot key gets one salt per ``hot_rows``: its rows
    pick one by a hash of their id, its entry on the right is repeated once per salt. There are at most as
    many hot keys as the left side has ``hot_rows``; Spark broadcasts their list if it is small.
    """
    hot = (left.groupBy(*on).agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") >= hot_rows)
           .select(*on, F.ceil(F.col("_copies") / hot_rows).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    spread = (left.join(hot, on, "left")
              .withColumn("_salt", F.pmod(F.xxhash64(row_id), salts).cast("int")).drop("_salts"))
    repeated = (right.join(hot, on, "left")
                .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts"))
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")


def splits_skewed_joins(df: DataFrame) -> bool:
    """Whether the session's adaptive execution splits skewed join partitions by itself."""
    conf = df.sparkSession.conf
    return all(conf.get(key) == "true" for key in (
        "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"))


def join_back(rows: DataFrame, results: DataFrame, key: str, row_id: str,
              hot_rows: int | None = None) -> DataFrame:
    """Bring per-key results, one row per key, back to the rows they were computed for.

    One key may hold a large share of the rows. Adaptive execution splits such a partition of the left
    side at run time where both sides are plainly shuffled. Where it is off, or where ``hot_rows`` is
    given, hot keys are salted.
    """
    if hot_rows is None:
        if splits_skewed_joins(rows):
            return rows.join(results, key, "left")
        hot_rows = 1_000_000
    return salted_join(rows, results, [key], row_id, "left", hot_rows)
