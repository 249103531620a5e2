"""Structured Streaming jobs over the same column expressions as the batch jobs.

Every job takes a streaming DataFrame and gives one back; ``run_available`` drives it over the data
present, with its output and checkpoint in shared storage.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from wardline.operators.engine import validate
from wardline.operators.metrics import exact_sum
from wardline.operators.ratelimit import REQUEST_LIMIT, WINDOW_SECONDS
from wardline.plans.policies import DEFAULT_CACHE_TTL, DEFAULT_POLICY
from wardline.session import scratch_dir

GATHERED_ROWS = 50_000  # rows a share gathers before it sets aside those that others of their window precede


def stream_of(spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files that match a pattern, as they arrive in a folder.

    What matches may be a file or a folder of files: large tables are folders. The braces make any name a pattern,
    which Spark needs to take a single file.
    """
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000)
            .parquet(f"{folder.rstrip('/')}/{{{files}}}"))


def validated(texts: DataFrame, guardrail: str = DEFAULT_POLICY, **options) -> DataFrame:
    """Verdicts of arriving texts: the batch projection, stateless."""
    return validate(texts, guardrail, **options)


def first_of_key(requests: DataFrame, keys: list[str], ts: str = "ts",
                 ttl: int = DEFAULT_CACHE_TTL) -> DataFrame:
    """Drops requests whose key was seen within the TTL; only the key is kept as state."""
    return requests.withWatermark(ts, f"{ttl} seconds").dropDuplicatesWithinWatermark(keys)


def windowed_counts(requests: DataFrame, ts: str, width: str, late: str, value: str,
                    *labels: str) -> DataFrame:
    """Count and sum per window and label; a window is emitted once no late row can reach it."""
    return (requests.withWatermark(ts, late)
            .groupBy(F.window(ts, width).alias("w"), *labels)
            .agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col(value)).alias("total"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *labels, "n", "total"))


def session_counts(requests: DataFrame, user: str, ts: str = "ts", gap: str = "30 minutes",
                   late: str = "10 minutes") -> DataFrame:
    """Requests per user session; a session is emitted once it can grow no more."""
    return (requests.withWatermark(ts, late)
            .groupBy(F.session_window(ts, gap).alias("s"), user)
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "requests"))


def limited(requests: DataFrame, client: list[str], ts: str = "ts", limit: int = REQUEST_LIMIT,
            window: int = WINDOW_SECONDS, late: str = "1 minute") -> DataFrame:
    """Admitted and rejected requests per client and fixed window.

    The state is one count per client and window, and counts are merged before the shuffle, so one
    client may send most of the traffic.
    """
    return (requests.withWatermark(ts, late)
            .groupBy(F.window(ts, f"{window} seconds").alias("w"), *client)
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *client, "requests", F.least("requests", F.lit(limit)).alias("admitted"),
                    F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected")))


def run_available(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run a stream over all data present, append its output to Parquet, and read that back."""
    spark = stream.sparkSession
    path = path or scratch_dir(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def spans_with_requests(spans: DataFrame, requests: DataFrame, span_ts: str, request_ts: str, span_key: str,
                        request_key: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Arriving spans with the arriving request they belong to, begun at most ``within`` before them.

    Both sides wait for each other in state. A span whose request does not come is given without one as soon as
    ``late`` has passed by the times of both sides; until then it is not given at all. A span that arrives later
    than that is given at once, without a request that is forgotten already; a request that late is dropped. A
    request meets any number of spans.
    """
    left = spans.withWatermark(span_ts, late)
    right = requests.withWatermark(request_ts, late)
    begun = F.col(span_ts) - F.expr(f"INTERVAL {within}")
    same = ((F.col(span_key) == F.col(request_key)) & (F.col(request_ts) <= F.col(span_ts))
            & (F.col(request_ts) >= begun))
    return left.join(right, same, "left")


def write_each_batch(stream: DataFrame, path: str, by: str) -> None:
    """Write a stream's batches as Parquet, one folder per batch number and value of ``by``.

    A batch that is run again, since the job failed between writing and noting it as done, replaces its own folder:
    its rows are there once. Runs over all data present; the folder is there even if no batch came.
    """
    spark = stream.sparkSession
    out = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/out")
    out.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(out)
    query = (stream.writeStream.foreachBatch(lambda rows, number: write_batch(rows, number, path, by))
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()


def write_batch(rows: DataFrame, number: int, path: str, by: str) -> None:
    rows.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(f"{path}/out/batch={number}")


def read_batches(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """What ``write_each_batch`` wrote, with the number of each row's batch.

    With the stream's schema, no batch at all gives an empty table.
    """
    reader = spark.read.option("basePath", f"{path}/out")
    if schema is not None:
        reader = reader.schema(StructType([*schema.fields, StructField("batch", LongType())]))
    return reader.parquet(f"{path}/out")


class ExpiringFirst(StatefulProcessor):
    """The rows of one key that find no live entry: the first, and each that comes once the last entry has expired.

    The state is when the entry expires; it goes once the rows' own times have passed that point.
    """

    def __init__(self, columns: list[str], order: list[str], ttl: int):
        self.columns, self.order, self.ttl = columns, order, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", StructType([StructField("second", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else None
        seen = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        fresh = []
        for second in seen[self.order[0]]:
            fresh.append(until is None or second >= until)
            if fresh[-1]:
                until = int(second) + self.ttl
        self.until.update((until,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(until * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield seen.loc[np.array(fresh), self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def with_rocksdb(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Run a stream whose processor keeps its state in RocksDB, whatever the session's own store is."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        spark.conf.set(provider, before)


def first_within_ttl(requests: DataFrame, keys: list[str], seconds: str, row_id: str, path: str,
                     ttl: int = DEFAULT_CACHE_TTL, late: str = "1 hour") -> DataFrame:
    """The requests that a cache whose entries live ``ttl`` seconds from being written would not answer.

    In the order of their times within a micro-batch; of one second the least ``row_id``. So several micro-batches in
    time order give what one replay of the whole log gives. An entry is forgotten ``late`` after its expiry by the
    requests' own times; a request that is later than that counts as the first of its key. Every task first keeps one
    request per key and second of a batch, so one key is at most a row per second and task, whatever its traffic.
    Runs over all data present and reads the requests back.
    """
    columns, order = requests.columns, [seconds, row_id]
    timed = requests.withColumn("_time", F.timestamp_seconds(F.col(seconds)))
    placed = timed.withWatermark("_time", late).select(*columns)

    def one_a_second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.sort_values(order, kind="stable").drop_duplicates([*keys, seconds])

    reduced = placed.mapInPandas(one_a_second, placed.schema)
    fresh = reduced.groupBy(*keys).transformWithStateInPandas(
        ExpiringFirst(columns, order, ttl), placed.schema, "append", "EventTime")
    return with_rocksdb(requests.sparkSession, lambda: run_available(fresh, "first-within-ttl", path))


class FirstOfWindow:
    """Tells, batch by batch, rows that cannot be among the first ``limit`` of their slot from those that may be.

    A row is beyond the limit for sure once ``limit`` rows of its slot with an earlier place were seen. Kept are the
    places of the first rows of at most ``slots`` slots; beyond that it forgets all, which lets more rows through.
    """

    def __init__(self, limit: int, slots: int = 100_000):
        self.limit, self.slots, self.first = limit, slots, {}

    def __call__(self, slot: tuple, place: tuple) -> bool:
        heap = self.first.get(slot)
        if heap is None:
            if len(self.first) >= self.slots:
                self.first.clear()
            heap = self.first[slot] = []
        if len(heap) < self.limit:
            bisect.insort(heap, place)
            return True
        if not heap or place >= heap[-1]:
            return False
        bisect.insort(heap, place)
        heap.pop()
        return True


class WindowLimiter(StatefulProcessor):
    """Decides the requests of one share of all slots (client and window) at once.

    The state is a list of the open slots of the share with the number admitted of each; a slot leaves it once its
    window has closed. A call costs the same for one slot and for hundreds, so there are few shares.
    """

    def __init__(self, columns: list[str], slot: StructType, order: list[str], limit: int, window: int):
        self.columns, self.slot, self.order, self.limit, self.window = columns, slot, order, limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("admitted", StructType([*self.slot.fields, StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, seen = timerValues.getCurrentWatermarkInMs(), self._seen()
        waiting, size, enough = [], 0, GATHERED_ROWS
        for part in rows:
            beyond = (part["is_sure"] | (self._end(part["window"]) <= now)).to_numpy(bool)
            if beyond.any():
                yield self._decided(part[beyond], True)
            if not beyond.all():
                waiting.append(part[~beyond])
                size += len(waiting[-1])
            if size >= enough:  # only the first rows of each slot so far are kept
                first, rest, _ = self._first(pd.concat(waiting), seen)
                yield self._decided(rest, True)
                waiting, size = [first], len(first)
                enough = 2 * size + GATHERED_ROWS
        if waiting:
            first, rest, counts = self._first(pd.concat(waiting), seen)
            yield self._decided(rest, True)
            yield self._decided(first, False)
            for slot, n in counts.items():
                seen[slot] = seen.get(slot, 0) + n
            self._keep(seen, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._seen(), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def _end(self, window):
        return (window + 1) * (self.window * 1000)

    def _seen(self) -> dict[tuple, int]:
        return {tuple(entry[:-1]): entry[-1] for entry in self.admitted.get()} if self.admitted.exists() else {}

    def _keep(self, seen: dict[tuple, int], now: int) -> None:
        """Keep the open slots, and a timer for the last of them to close."""
        kept = [(*slot, n) for slot, n in seen.items() if self._end(slot[-1]) > now]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.admitted.put(kept)
            self.handle.registerTimer(max(self._end(entry[-2]) for entry in kept))
        else:
            self.admitted.clear()

    def _first(self, rows: pd.DataFrame, seen: dict[tuple, int]) -> tuple[pd.DataFrame, pd.DataFrame, dict[tuple, int]]:
        """The rows there is still room for in their slots, the others, and the number of the former by slot."""
        rows = rows.sort_values(self.order, kind="stable")
        columns = [rows[c].astype(object).where(rows[c].notna(), None) for c in self.slot.names]
        numbers: dict[tuple, int] = {}
        codes = np.array([numbers.setdefault(slot, len(numbers)) for slot in zip(*columns)])
        room = np.array([self.limit - seen.get(slot, 0) for slot in numbers])
        fits = pd.Series(codes).groupby(codes).cumcount().to_numpy() < room[codes]
        counts = np.bincount(codes[fits], minlength=len(numbers)).tolist()
        return rows[fits], rows[~fits], {slot: n for slot, n in zip(numbers, counts) if n}

    def _decided(self, rows: pd.DataFrame, rejected: bool) -> pd.DataFrame:
        return rows[self.columns].assign(rejected=rejected)

    def close(self) -> None:
        pass


def by_share(sorted_out: DataFrame, slot: list[str], spread: int) -> DataFrame:
    """The rows with ``_share``, by which they are gathered: that of their slot, or any for rows decided already."""
    return sorted_out.withColumn("_share", F.when(F.col("is_sure"), F.col("_any")).otherwise(
        F.pmod(F.xxhash64(*slot), F.lit(spread)).cast("int"))).drop("_any")


def limit_requests(requests: DataFrame, client: list[str], seconds: str, row_id: str, path: str,
                   limit: int = REQUEST_LIMIT, window: int = WINDOW_SECONDS, late: str = "1 hour",
                   spread: int = 1024) -> DataFrame:
    """Decide for each arriving request whether it is beyond the limit of its client and window.

    Spark keeps one number per client and window in its RocksDB state: how many were admitted. Clients and windows
    are dealt to ``spread`` shares by a hash, and a share is decided in one call of Python. Within a micro-batch
    the earlier requests of a window go first. Every task first sets aside the requests that ``limit`` earlier ones
    of their window precede: they are rejected without being gathered by window, so the task that decides a window gets
    about ``limit`` requests from every task, however many there are. A window closes once no request can be
    expected any more, ``late`` after its end by the requests' own times; its number goes then, and what still
    arrives for it is rejected. So every request gets one decision. A batch that is run again after a failure
    starts from the same state. Runs over all data present and reads the decisions back.
    """
    spark = requests.sparkSession
    columns, order = [*requests.columns, "window"], [seconds, row_id]
    slot = [*client, "window"]
    timed = requests.withColumns({
        "window": F.floor(F.col(seconds) / window), "_time": F.timestamp_seconds(F.col(seconds))})
    # Spark renames columns that begin with an underscore on their way to the processor
    # the watermark is drawn here and its column left behind: nothing is dropped for being late
    placed = timed.withWatermark("_time", late).select(
        *columns, F.lit(False).alias("is_sure"), F.lit(0).alias("_any"))

    def sort_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        may_pass = FirstOfWindow(limit)
        for rows in batches:
            slots = zip(*(rows[c] for c in slot))
            places = zip(rows[seconds], rows[row_id])
            sure = [not may_pass(where, place) for where, place in zip(slots, places)]
            yield rows.assign(is_sure=sure, _any=(np.arange(len(rows)) % spread).astype(np.int32))

    sorted_out = placed.mapInPandas(sort_out, placed.schema)
    output = StructType([*placed.select(*columns).schema.fields, StructField("rejected", BooleanType())])
    limiter = WindowLimiter(columns, placed.select(*slot).schema, order, limit, window)
    decided = by_share(sorted_out, slot, spread).groupBy("_share").transformWithStateInPandas(
        limiter, output, "append", "EventTime")
    return with_rocksdb(spark, lambda: run_available(decided, "limit-requests", path))
