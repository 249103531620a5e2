"""Result reuse: keys, score-once, probing a result store, and replaying a log against a TTL.

Nothing here sorts or collects the rows of one key in one task. Counting per time slice first leaves
at most one row per key and slice, however many requests the key has, and the slices are chosen so
that the answer stays exact.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.joins import join_back, lookup_join
from wardline.operators.metrics import position
from wardline.operators.slices import running_sum
from wardline.plans.policies import DEFAULT_CACHE_TTL
from wardline.session import written_tables

SECOND = 1_000_000  # microseconds


def cache_key(text: Column, resolved: Column, version: Column) -> Column:
    """Same text, policy and policy version: same key. Request ids play no part."""
    return F.md5(F.concat_ws("\x01", resolved, version, text))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def unique_texts(df: DataFrame, row_id: str, key: str = "cache_key", text: str = "text") -> DataFrame:
    """One row per key: its text and the first row id.

    Copies meet in the map-side aggregation, so a text that fills a third of the table ships once per
    task.
    """
    return df.groupBy(key, text).agg(F.min(row_id).alias("first_id"))


def with_cache_hit(df: DataFrame, row_id: str, key: str = "cache_key") -> DataFrame:
    """Marks all but the first row of each key as hits.

    The join back is on the row id, which is unique, so copies cannot pile up in one task.
    """
    first = df.groupBy(key).agg(F.min(row_id).alias(row_id)).select(row_id, F.lit(False).alias("_hit"))
    return (df.join(first, row_id, "left")
            .withColumn("cache_hit", F.coalesce("_hit", F.lit(True))).drop("_hit"))


def score_once(df: DataFrame, score: Callable[[DataFrame], DataFrame], row_id: str,
               key: str = "cache_key", text: str = "text", hot_rows: int | None = None) -> DataFrame:
    """Score each different text once and give every copy the result.

    ``score`` adds result columns to the table it is given and keeps the others. Worth its two
    shuffles when scoring is dear, such as a model call; the default scorers are cheaper than that.
    """
    results = score(unique_texts(df, row_id, key, text)).drop(text)
    joined = join_back(df, results, key, row_id, hot_rows)
    return joined.withColumn("cache_hit", F.col(row_id) != F.col("first_id")).drop("first_id")


def live_entries(store: DataFrame, as_of: Column, key: str = "cache_key") -> DataFrame:
    """The newest entry per key among those still alive at ``as_of``."""
    others = [c for c in store.columns if c != key]
    return (store.where((F.col("written_at") <= as_of) & (F.col("expires_at") > as_of))
            .groupBy(key).agg(F.max(F.struct("written_at", *[c for c in others if c != "written_at"]))
                              .alias("_entry"))
            .select(key, "_entry.*"))


def store_entries(results: DataFrame, written_at: Column, ttl: int | Column = DEFAULT_CACHE_TTL) -> DataFrame:
    """Results as store rows: written at a given time, gone ``ttl`` seconds later.

    ``ttl`` may be a column, such as the lifetime that the request itself asked for.
    """
    seconds = (F.lit(ttl) if isinstance(ttl, int) else ttl).cast("long")
    return (results.withColumn("written_at", written_at)
            .withColumn("expires_at", F.timestamp_micros(micros(F.col("written_at")) + seconds * SECOND))
            .withColumn("expires_on", F.to_date("expires_at")))


def probe(requests: DataFrame, live: DataFrame, row_id: str, key: str = "cache_key",
          bypass: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """How the store answers each request: ``hit``, ``miss``, or ``bypass`` when it is not asked."""
    asked = requests if bypass is None else requests.where(~F.col(bypass))
    found = live.select(key, F.lit("hit").alias("outcome"))
    answered = (join_back(asked, found, key, row_id, hot_rows)
                .withColumn("outcome", F.coalesce("outcome", F.lit("miss"))))
    if bypass is None:
        return answered
    return answered.unionByName(requests.where(F.col(bypass)).withColumn("outcome", F.lit("bypass")))


def store_join(asked: DataFrame, store: DataFrame, key: str, keep: Callable[[DataFrame], DataFrame],
               hot_rows: int = 1_000_000) -> DataFrame:
    """Requests with the entry of their key, from a store bucketed by key; NULL columns where it has none.

    The store is read by its buckets and not shuffled; only the requests travel to them. A key with ``hot_rows``
    requests or more would fill one bucket's task, so the entries of such keys, at most as many as the requests
    divided by ``hot_rows``, are looked up first and joined to their requests where those are.
    """
    hot = keep(asked.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows).select(key))
    if not hot.limit(1).count():
        return asked.join(store, key, "left")
    entries = keep(hot.join(store, key, "left"))  # one row per hot key
    busy = lookup_join(asked, entries, [key], key, "inner", hot_rows=hot_rows)
    others = lookup_join(asked, hot, [key], key, "left_anti", hot_rows=hot_rows)
    return others.join(store, key, "left").unionByName(busy)


def validate_through_store(requests: DataFrame, live: DataFrame,
                           score: Callable[[DataFrame], DataFrame], row_id: str,
                           key: str = "cache_key", text: str = "text", bypass: str | None = None,
                           hot_rows: int | None = None, bucketed: bool = False) -> DataFrame:
    """Validate requests, reusing live store entries and scoring each missing text once.

    ``score`` adds result columns to the table it is given and keeps the others; ``live`` has the key
    and those columns, one row per key. ``cache_hit`` is true for answers from the store and for all but the first
    copy of a newly scored text. Bypassing requests are scored themselves and never count as hits.
    Gives the row id, the key and the results. The store is asked once, by row id and key alone; the answers lie in
    the shared folder, so the misses among them have a known size and are computed once. Of texts only the first
    one of each missing key is fetched, by its row id. ``bucketed`` says that the store is a table of
    ``sinks.write_bucketed_store``, which is then not shuffled.
    """
    keep = written_tables(requests.sparkSession, "through-store")
    asked = requests if bypass is None else requests.where(~F.coalesce(F.col(bypass), F.lit(False)))
    names = [c for c in live.columns if c != key]
    known = live.select(key, F.struct(*names).alias("_entry"))
    slim = asked.select(row_id, key)
    if bucketed:
        found = store_join(slim, known, key, keep, hot_rows or 1_000_000)
    else:
        found = join_back(slim, known, key, row_id, hot_rows)
    found = keep(found)
    missed = found.where(F.col("_entry").isNull()).select(row_id, key)
    first = missed.groupBy(key).agg(F.min(row_id).alias(row_id)).select(row_id)
    extra = [c for c in asked.columns if c not in (row_id, key, text)]
    scored = keep(score(asked.join(first, row_id, "left_semi")).drop(text, *extra).withColumnRenamed(row_id, "first_id"))
    reused = found.where(F.col("_entry").isNotNull()).select(row_id, key, "_entry.*", F.lit(True).alias("cache_hit"))
    fresh = join_back(missed, scored, key, row_id, hot_rows)
    answered = reused.unionByName(fresh.select(
        row_id, key, *names, (F.col(row_id) != F.col("first_id")).alias("cache_hit")))
    if bypass is None:
        return answered
    direct = (score(requests.where(F.coalesce(F.col(bypass), F.lit(False)))).withColumn("cache_hit", F.lit(False)))
    return answered.unionByName(direct.select(*answered.columns))


def replay_refreshing(log: DataFrame, keys: list[str], ts: str = "ts", row_id: str = "event_id",
                      ttl: int = DEFAULT_CACHE_TTL) -> DataFrame:
    """Replay of a log on a cache whose entries live ``ttl`` seconds from their last use.

    A request hits when the same key was seen at most ``ttl`` seconds before. In a slice of ``ttl``
    seconds only the first request of a key can miss, so each slice shrinks to one row before its
    predecessor is looked up. Gives per slice: requests, hits, and the id of the missing request.
    """
    at = micros(F.col(ts))
    slices = (log.groupBy(*keys, F.floor(at / (ttl * SECOND)).alias("slice"))
              .agg(F.count(F.lit(1)).alias("requests"),
                   F.min(at).alias("first_at"), F.max(at).alias("last_at"),
                   F.min_by(row_id, position(at, F.col(row_id))).alias("first_id")))
    before = F.lag("last_at").over(Window.partitionBy(*keys).orderBy("slice"))
    hit = F.coalesce(F.col("first_at") - F.col("_before") <= ttl * SECOND, F.lit(False))
    return (slices.withColumn("_before", before)
            .select(*keys, "slice", "requests",
                    (F.col("requests") - F.when(hit, 0).otherwise(1)).alias("hits"),
                    F.when(~hit, F.col("first_id")).alias("missing_id")))


def miss_links(seconds: DataFrame, ttl: int) -> DataFrame:
    """(_key, sec, next): the second at which a request misses next, if one at ``sec`` missed; NULL after the last.

    ``seconds`` has the distinct ``_key, sec`` with requests. An entry written at ``sec`` is dead from ``sec + ttl``
    on. That point lies in the next slice of ``ttl`` seconds, where the first second from there on is looked up;
    else the next miss is the first second of the slice after it. Where that slice is empty too, a pause of more
    than ``ttl`` follows, after which a request misses anyhow: such links are left out. A task holds the seconds of
    one slice and the points that reach it, at most ``ttl`` each.
    """
    own = F.floor(F.col("sec") / ttl)
    there = seconds.select("_key", own.alias("_slice"), F.col("sec").alias("_at"), F.lit(1).alias("_is"),
                           F.col("sec").alias("_there"), F.lit(None).cast("long").alias("_from"))
    asked = seconds.select("_key", (own + 1).alias("_slice"), (F.col("sec") + ttl).alias("_at"), F.lit(0).alias("_is"),
                           F.lit(None).cast("long").alias("_there"), F.col("sec").alias("_from"))
    later = (Window.partitionBy("_key", "_slice").orderBy(F.desc("_at"), F.desc("_is"))
             .rowsBetween(Window.unboundedPreceding, 0))
    found = (there.unionByName(asked).withColumn("_next", F.min("_there").over(later))
             .where(F.col("_from").isNotNull()))
    first = seconds.groupBy("_key", (own - 1).alias("_slice")).agg(F.min("sec").alias("_first"))
    return (found.join(first, ["_key", "_slice"], "left")
            .select("_key", F.col("_from").alias("sec"), F.coalesce("_next", "_first").alias("next")))


def misses_of_runs(roots: DataFrame, links: DataFrame, longest: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(_key, sec) of all misses: ``roots`` and what the links lead to from them, by pointer doubling.

    Round by round a pointer reaches twice as far, and the misses known so far find as many again. Pointers that
    run out are dropped, so runs shorter than the reach cost nothing any more. No step walks along a run.
    ``longest`` bounds the misses of a run; ``keep`` writes a table and reads it back.
    """
    known, jumps, reach = roots.select("_key", "sec"), keep(links.where("next is not null")), 1
    with ThreadPoolExecutor(2) as pool:
        while reach < longest:
            found = known.join(jumps, ["_key", "sec"]).select("_key", F.col("next").alias("sec"))
            more = pool.submit(keep, known.unionByName(found))  # while the pointers of the next round are written
            reach *= 2
            if reach < longest:
                onward = jumps.select("_key", F.col("sec").alias("next"), F.col("next").alias("_next"))
                jumps = keep(jumps.join(onward, ["_key", "next"]).select("_key", "sec", F.col("_next").alias("next")))
            known = more.result()
    return known


def replay_exact(log: DataFrame, keys: list[str], ts: str = "ts", ttl: int = DEFAULT_CACHE_TTL) -> DataFrame:
    """Replay on a cache whose entries live ``ttl`` seconds from being written. Per key and run.

    The clock ticks in whole seconds, as TTLs do. A miss writes the entry, requests before its expiry
    hit, the next one misses. A pause of at least ``ttl`` outlives every entry and starts a new run, whose first
    request misses; the other misses follow from there by links (``misses_of_runs``). A key that never pauses is
    one run, whose seconds are dealt to tasks by slices of ``ttl``. Tables between rounds lie in the shared folder.
    """
    keep = written_tables(log.sparkSession, "replay")
    seconds = keep(log.groupBy(F.struct(*keys).alias("_key"), F.floor(micros(F.col(ts)) / SECOND).alias("sec"))
                   .agg(F.count(F.lit(1)).alias("n")))
    slices = keep(seconds.groupBy("_key", F.floor(F.col("sec") / ttl).alias("_slice")).agg(
        F.min("sec").alias("_first"), F.max("sec").alias("_last"), F.sum("n").alias("_n")))
    # only the first second of a slice can follow a pause, and only a second of the slice before can prevent it
    before = slices.select("_key", (F.col("_slice") + 1).alias("_slice"), F.col("_last").alias("_before"))
    fresh = F.coalesce(F.col("_first") - F.col("_before") < ttl, F.lit(False))
    started = (slices.join(before, ["_key", "_slice"], "left")
               .withColumn("_start", F.when(fresh, 0).otherwise(1)))
    numbered = keep(running_sum(started, ["_key"], "_slice", "_start", "run", 4096)
                    .select("_key", "_slice", "_first", "_n", "_start", "run"))
    runs = numbered.groupBy("_key", "run").agg(F.sum("_n").alias("requests"), F.count(F.lit(1)).alias("_slices"))
    longest = runs.agg(F.max("_slices")).first()[0] or 0  # a slice of ttl seconds has one miss at most
    roots = numbered.where("_start = 1").select("_key", F.col("_first").alias("sec"))
    links = miss_links(seconds.select("_key", "sec"), ttl)  # a link to the start of a run would find it twice
    inside = links.join(roots.select("_key", F.col("sec").alias("next")), ["_key", "next"], "left_anti")
    found = misses_of_runs(roots, inside, longest, keep)
    missed = (found.withColumn("_slice", F.floor(F.col("sec") / ttl)).join(
        numbered.select("_key", "_slice", "run"), ["_key", "_slice"])
        .groupBy("_key", "run").agg(F.count(F.lit(1)).alias("misses")))
    return (runs.join(missed, ["_key", "run"])
            .select(*[F.col("_key")[k].alias(k) for k in keys], "run", "requests", "misses",
                    (F.col("requests") - F.col("misses")).alias("hits")))


def live_hits(probes: DataFrame, entries: DataFrame, keys: list[str], ts: str = "ts",
              slice_seconds: int = 3600) -> DataFrame:
    """The probes that find an entry with ``written_at <= ts < expires_at``.

    A range join as an equi-join on the key and a time slice: an entry is listed in each slice it
    lives in, a probe in one. The slice also splits a hot key over many tasks.
    """
    width = slice_seconds * SECOND
    listed = entries.select(
        *[F.col(k).alias(f"_e_{k}") for k in keys], "written_at", "expires_at",
        F.explode(F.sequence(F.floor(micros(F.col("written_at")) / width),
                             F.floor((micros(F.col("expires_at")) - 1) / width))).alias("_e_slice"))
    located = probes.withColumn("_slice", F.floor(micros(F.col(ts)) / width))
    same = F.col("_slice") == F.col("_e_slice")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_e_{k}"))
    alive = (F.col("written_at") <= F.col(ts)) & (F.col(ts) < F.col("expires_at"))
    return located.join(listed, same & alive, "left_semi").drop("_slice")
