"""Rate limits: who exceeded a request limit, and the load in a sliding window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.slices import trailing_sum

# ---- Fixed values ---------------------------------------------------------------------------------
REQUEST_LIMIT, BATCH_REQUEST_LIMIT, WINDOW_SECONDS = 100, 200, 60
# ---- End of fixed values --------------------------------------------------------------------------


def admitted_ids(requests: DataFrame, slot: list[str], order: list[str], row_id: str, limit: int,
                 salts: int) -> DataFrame:
    """The ids of the first ``limit`` requests of every slot.

    A slot is first cut into ``salts`` shares, in which a request beyond the limit has that many before it; the
    others, at most ``limit`` times ``salts`` per slot, are ranked together. Up to 1,000 Spark applies either limit
    within every task before it shuffles, so what travels is a few rows per slot and task, not the log.
    """
    names = list(dict.fromkeys([*slot, *order, row_id]))
    shares = Window.partitionBy(*slot, "_share").orderBy(*order)
    together = Window.partitionBy(*slot).orderBy(*order)
    return (requests.select(*names, F.pmod(F.xxhash64(row_id), F.lit(salts)).alias("_share"))
            .withColumn("_rank", F.row_number().over(shares)).where(F.col("_rank") <= limit)
            .withColumn("_rank", F.row_number().over(together)).where(F.col("_rank") <= limit).select(row_id))


def rejected_requests(requests: DataFrame, client: list[str], seconds: str, row_id: str,
                      limit: int = REQUEST_LIMIT, window: int = WINDOW_SECONDS,
                      salts: int = 32) -> DataFrame:
    """Marks requests beyond the limit of their client and fixed window, in order of arrival.

    ``row_id`` is unique. The log is shuffled once at most, by its ids, to meet the admitted ones; not at all where
    those are few enough for Spark to broadcast them.
    """
    placed = requests.withColumn("window", F.floor(F.col(seconds) / window))
    admitted = admitted_ids(placed, [*client, "window"], [seconds, row_id], row_id, limit, salts)
    return (placed.join(admitted.withColumn("_admitted", F.lit(True)), row_id, "left")
            .withColumn("rejected", F.col("_admitted").isNull()).drop("_admitted"))


def limit_summary(requests: DataFrame, client: list[str], seconds: str, limit: int = REQUEST_LIMIT,
                  window: int = WINDOW_SECONDS) -> DataFrame:
    """Requests, admitted and rejected per client and window; needs no ranking at all."""
    return (requests.groupBy(*client, F.floor(F.col(seconds) / window).alias("window"))
            .agg(F.count(F.lit(1)).alias("requests"))
            .withColumn("admitted", F.least("requests", F.lit(limit)))
            .withColumn("rejected", F.greatest(F.col("requests") - limit, F.lit(0))))


def sliding_load(requests: DataFrame, client: list[str], seconds: str,
                 window: int = WINDOW_SECONDS, slice_seconds: int | None = None) -> DataFrame:
    """Requests of each client in the trailing window, for every second with a request.

    Requests of the same second share their window, so seconds are counted first. The seconds of a client are
    cut into slices that know the end of the slice before, so one client is dealt to many tasks.
    """
    per_second = (requests.groupBy(*client, F.floor(seconds).alias("second"))
                  .agg(F.count(F.lit(1)).alias("requests")))
    return trailing_sum(per_second, client, "second", "requests", "load", window, slice_seconds)
