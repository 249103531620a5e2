"""Queries on result reuse, batches and stored results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators import cache, engine, metrics, requests
from wardline.plans import policies, sql
from wardline.plans.catalog import query
from wardline.plans.text_queries import assigned, texts
from wardline.session import scratch_dir
from wardline.sources import sinks, tables

_VERSIONS = "CASE " + " ".join(
    f"WHEN g = '{name}' THEN '{policy.version}'" for name, policy in policies.REGISTRY.items()) + " END"
_NUMBER = "CAST(substr(source, 4) AS INT)"
_STRICT = f"{sql.by_policy('strict')}, v AS (SELECT *, {sql.VALID} AS valid, {sql.ACTION} AS action FROM f)"


def source_number() -> Column:
    return F.substring("source", 4, 9).cast("int")


def keyed(docs: DataFrame, guardrail: str) -> DataFrame:
    """Documents with the key of their result under one policy."""
    policy = policies.REGISTRY[guardrail]
    return docs.withColumn("cache_key", cache.cache_key(
        F.col("text"), F.lit(policy.name), F.lit(policy.version)))


def strict_score(df: DataFrame) -> DataFrame:
    return engine.validate(df, "strict").select(*df.columns, "valid", "action")


@query(f"""WITH r AS (SELECT doc_id, text, CASE WHEN {sql.REQUESTED} = 'unlisted' THEN 'default'
                             ELSE {sql.REQUESTED} END AS g FROM documents)
           SELECT doc_id, md5(concat_ws(chr(1), g, {_VERSIONS}, text)) AS cache_key FROM r""")
def cache_keys(spark, folder):
    docs = assigned(spark, folder)
    resolved = policies.resolved_guardrail(F.col("guardrail"))
    return docs.select("doc_id", cache.cache_key(
        F.col("text"), resolved, policies.policy_version(resolved)).alias("cache_key"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS cache_hit FROM documents""")
def cache_dedup(spark, folder):
    """The first document of each text is the miss, its copies are hits."""
    docs = keyed(tables.documents(spark, folder), "default").select("doc_id", "cache_key")
    return cache.with_cache_hit(docs, "doc_id").select("doc_id", "cache_hit")


@query(f"""{_STRICT} SELECT doc_id, valid, action,
           row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS cache_hit FROM v""")
def score_once(spark, folder):
    """Each different text is scored once; its copies share the result."""
    docs = keyed(texts(spark, folder), "strict")
    return (cache.score_once(docs, strict_score, "doc_id")
            .select("doc_id", "valid", "action", "cache_hit"))


_PROBED = f"""WITH s AS (SELECT DISTINCT text AS known FROM documents WHERE {_NUMBER} < 10),
    r AS (SELECT doc_id, lang, text, CASE WHEN lang = 'de' THEN 'bypass' WHEN known IS NOT NULL THEN 'hit'
                 ELSE 'miss' END AS outcome FROM documents LEFT JOIN s ON text = known)"""


def _probed(spark, folder) -> DataFrame:
    """Documents probed against the results of half of the sources; German ones bypass the store."""
    docs = keyed(tables.documents(spark, folder), "default").select("doc_id", "cache_key", "lang", "source")
    live = docs.where(source_number() < 10).select("cache_key").distinct()
    asking = docs.withColumn("skip_cache", F.col("lang") == "de").select(
        "doc_id", "cache_key", "lang", "skip_cache")
    return cache.probe(asking, live, "doc_id", bypass="skip_cache")


@query(f"{_PROBED} SELECT doc_id, outcome FROM r")
def cache_probe(spark, folder):
    return _probed(spark, folder).select("doc_id", "outcome")


@query(f"""{_PROBED} SELECT 'get' AS operation, outcome AS result, count(*) AS n FROM r WHERE outcome <> 'bypass'
           GROUP BY outcome UNION ALL
           SELECT 'set', 'ok', count(DISTINCT text) FROM r WHERE outcome = 'miss'""")
def cache_operations(spark, folder):
    """Reads by result, and one write per different text that was missing."""
    probed = _probed(spark, folder)
    gets = (metrics.counter(probed.where(F.col("outcome") != "bypass"), "outcome")
            .select(F.lit("get").alias("operation"), F.col("outcome").alias("result"), "n"))
    missing = probed.where(F.col("outcome") == "miss").select("cache_key").distinct()
    sets = missing.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("set").alias("operation"), F.lit("ok").alias("result"), "n")
    return gets.unionByName(sets)


@query(f"""{_PROBED}, c AS (SELECT lang, count(CASE WHEN outcome = 'hit' THEN 1 END) AS hits,
                                   count(CASE WHEN outcome = 'miss' THEN 1 END) AS misses FROM r GROUP BY lang)
           SELECT lang, hits, misses,
                  CASE WHEN hits + misses > 0 THEN round(CAST(hits AS DOUBLE) / (hits + misses), 6) END AS hit_ratio
           FROM c""")
def cache_hit_ratio(spark, folder):
    """Hit ratio per language; undefined where every request bypasses the store."""
    counts = _probed(spark, folder).groupBy("lang").agg(
        F.count(F.when(F.col("outcome") == "hit", 1)).alias("hits"),
        F.count(F.when(F.col("outcome") == "miss", 1)).alias("misses"))
    return counts.withColumn("hit_ratio", F.round(metrics.hit_ratio(F.col("hits"), F.col("misses")), 6))


# requests made of documents: some empty, some with a lifetime out of range, German ones past the store
_REQUESTS = f"""{sql.by_source()},
    v AS (SELECT *, {sql.VALID} AS ok, {sql.ACTION} AS act,
                 CASE WHEN doc_id % 19 = 5 THEN 'empty_text' WHEN length(text) > 50000 THEN 'text_too_long'
                      WHEN doc_id % 17 = 3 THEN 'ttl_out_of_range' END AS reason FROM f),
    s AS (SELECT DISTINCT guardrail AS g, text AS known FROM v WHERE {_NUMBER} < 10 AND length(text) <= 50000),
    a AS (SELECT v.*, known, row_number() OVER (PARTITION BY text, guardrail, lang = 'de' ORDER BY doc_id) AS k
          FROM v LEFT JOIN s ON text = known AND guardrail = g WHERE reason IS NULL),
    r AS (SELECT doc_id, reason, guardrail, ok AS valid, act AS action, lang <> 'de' AND (known IS NOT NULL OR k > 1) AS cache_hit,
                 300 + doc_id % 100 AS ttl, lang = 'de' AS past,
                 concat_ws(',', CASE WHEN sent_thr IS NOT NULL THEN 'lexicon-sentiment-1' END, 'lexicon-toxicity-1',
                           CASE WHEN pii_act IS NOT NULL THEN 'pattern-pii-1' END) AS models FROM a
          UNION ALL SELECT doc_id, reason, guardrail, false, 'block', false, NULL, lang = 'de', NULL FROM v WHERE reason IS NOT NULL)"""


def request_responses(spark, folder) -> DataFrame:
    docs = assigned(spark, folder, "lang")
    ttl = F.when(F.col("doc_id") % 17 == 3, 4000).otherwise(300 + F.col("doc_id") % 100).cast("int")
    asking = docs.select(
        F.col("doc_id"), F.when(F.col("doc_id") % 19 == 5, "").otherwise(F.col("text")).alias("text"), "guardrail",
        ttl.alias("cache_ttl"), (F.col("lang") == "de").alias("skip_cache"))
    earlier = (docs.where((source_number() < 10) & (F.length("text") <= 50000))
               .select("doc_id", "text", "guardrail", F.lit(300).alias("cache_ttl"), F.lit(False).alias("skip_cache")))
    stored = requests.admitted(earlier).groupBy("cache_key", "resolved", "text").agg(F.min("doc_id").alias("doc_id"))
    live = requests.scorer()(stored).select("cache_key", *requests.RESULTS)
    return requests.answer(asking, live, "doc_id")


@query(f"""{_REQUESTS} SELECT doc_id, reason AS reject_reason, guardrail AS resolved_guardrail, valid, action,
           cache_hit, models, CASE WHEN reason IS NULL THEN 'Validation completed successfully' ELSE 'Invalid request: ' || reason END AS message FROM r""")
def request_pipeline(spark, folder):
    """Requests through admission, store, validation and response."""
    return request_responses(spark, folder).select(
        "doc_id", "reject_reason", "resolved_guardrail", "valid", "action", "cache_hit",
        F.when(F.col("model_info").isNotNull(), F.array_join(F.array_sort(F.map_values("model_info")), ","))
        .alias("models"), "message")


@query(f"""{_REQUESTS} SELECT guardrail AS resolved_guardrail, count(*) AS entries, CAST(sum(ttl) AS BIGINT) AS lifetimes
           FROM r WHERE reason IS NULL AND NOT cache_hit AND NOT past GROUP BY 1""")
def request_entries(spark, folder):
    """What the requests write back: entries and their lifetimes, as each first request asked."""
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    written = requests.entries(request_responses(spark, folder), now, "doc_id")
    alive = F.unix_seconds("expires_at") - F.unix_seconds("written_at")
    return written.groupBy("resolved_guardrail").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(alive).alias("lifetimes"))


@query(f"""{_STRICT}, s AS (SELECT DISTINCT text AS known FROM documents WHERE {_NUMBER} < 10),
    r AS (SELECT v.*, known, row_number() OVER (PARTITION BY text, lang = 'de' ORDER BY doc_id) AS k
          FROM v LEFT JOIN s ON text = known)
    SELECT doc_id, valid, action, CASE WHEN lang = 'de' THEN false ELSE known IS NOT NULL OR k > 1 END AS cache_hit
    FROM r""")
def validate_through_store(spark, folder):
    """Documents validated with the results of an earlier run at hand."""
    docs = keyed(texts(spark, folder, "lang", "source"), "strict")
    live = (strict_score(docs.where(source_number() < 10).select("cache_key", "text").distinct())
            .select("cache_key", "valid", "action"))
    asking = docs.withColumn("skip_cache", F.col("lang") == "de").select(
        "doc_id", "text", "cache_key", "skip_cache")
    return (cache.validate_through_store(asking, live, strict_score, "doc_id", bypass="skip_cache")
            .select("doc_id", "valid", "action", "cache_hit"))


@query(f"""{_STRICT}, s AS (SELECT DISTINCT text AS known FROM documents WHERE {_NUMBER} < 10),
    r AS (SELECT v.*, known, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k
          FROM v LEFT JOIN s ON text = known)
    SELECT doc_id, valid, action, known IS NOT NULL OR k > 1 AS cache_hit FROM r""")
def validate_bucketed_store(spark, folder):
    """The same with the earlier results in a store bucketed by key, which the probe leaves where it is."""
    docs = keyed(texts(spark, folder, "source"), "strict")
    earlier = strict_score(docs.where(source_number() < 10).select("cache_key", "text").dropDuplicates(["cache_key"]))
    path = scratch_dir(spark, "bucketed")
    store = sinks.write_bucketed_store(
        cache.store_entries(earlier.drop("text"), F.timestamp_seconds(F.lit(1_704_067_200)), 3600),
        f"store_{uuid.uuid4().hex}", path, buckets=8)
    live = store.where(F.col("expires_at") > F.timestamp_seconds(F.lit(1_704_067_300))).select("cache_key", "valid", "action")
    return (cache.validate_through_store(docs.select("doc_id", "text", "cache_key"), live, strict_score, "doc_id", bucketed=True)
            .select("doc_id", "valid", "action", "cache_hit"))


_LAGGED = """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events),
    l AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id, event_type ORDER BY us) AS gap FROM e)"""


@query(f"""{_LAGGED} SELECT user_id, event_type, count(*) AS requests,
           count(CASE WHEN gap <= 3600 * 1000000::BIGINT THEN 1 END) AS hits FROM l GROUP BY 1, 2""")
def cache_ttl_replay(spark, folder):
    """Hits of the request log on a cache whose entries live an hour from their last use."""
    return (cache.replay_refreshing(tables.events(spark, folder), ["user_id", "event_type"], ttl=3600)
            .groupBy("user_id", "event_type")
            .agg(F.sum("requests").alias("requests"), F.sum("hits").alias("hits")))


@query(f"{_LAGGED} SELECT event_id FROM l WHERE coalesce(gap, 3600 * 1000000::BIGINT + 1) > 3600 * 1000000::BIGINT")
def cache_ttl_misses(spark, folder):
    """The requests that miss in the same replay."""
    return (cache.replay_refreshing(tables.events(spark, folder), ["user_id", "event_type"], ttl=3600)
            .where(F.col("missing_id").isNotNull()).select(F.col("missing_id").alias("event_id")))


@query("""WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) // 1000000 AS sec, count(*) AS n FROM events GROUP BY 1, 2),
    w(user_id, sec) AS (
      SELECT user_id, min(sec) FROM s GROUP BY user_id
      UNION ALL
      SELECT s.user_id, min(s.sec) FROM w JOIN s ON s.user_id = w.user_id AND s.sec >= w.sec + 21600
      GROUP BY s.user_id, w.sec)
    SELECT t.user_id, t.requests, m.misses, t.requests - m.misses AS hits
    FROM (SELECT user_id, CAST(sum(n) AS BIGINT) AS requests FROM s GROUP BY 1) t
    JOIN (SELECT user_id, count(*) AS misses FROM w GROUP BY 1) m ON m.user_id = t.user_id""")
def cache_ttl_exact(spark, folder):
    """The log on a cache whose entries live six hours from being written."""
    return (cache.replay_exact(tables.events(spark, folder), ["user_id"], ttl=21600)
            .groupBy("user_id").agg(*[F.sum(c).alias(c) for c in ("requests", "misses", "hits")]))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
    s AS (SELECT user_id AS u, min(us) AS w FROM e GROUP BY user_id, us // 86400000000)
    SELECT event_id FROM e WHERE EXISTS (
      SELECT 1 FROM s WHERE u = user_id AND w <= us AND us < w + 7200 * 1000000::BIGINT)""")
def cache_expiry(spark, folder):
    """Requests that find a live entry, when each user's first request of a day writes one for two hours."""
    log = tables.events(spark, folder).select("event_id", "user_id", "ts")
    day = F.floor(cache.micros(F.col("ts")) / (86400 * cache.SECOND))
    entries = cache.store_entries(
        log.groupBy("user_id", day.alias("day")).agg(F.min("ts").alias("first")), F.col("first"), 7200)
    return cache.live_hits(log, entries, ["user_id"]).select("event_id")


@query(f"""{_STRICT}, w AS (SELECT *, doc_id // 3 AS minute FROM v),
    a AS (SELECT text, max(minute) AS minute, bool_or(valid) AS valid FROM w
          WHERE minute <= 120 AND minute + 60 > 120 GROUP BY text)
    SELECT md5(concat_ws(chr(1), 'strict', '{policies.REGISTRY["strict"].version}', text)) AS cache_key,
           minute, valid FROM a""")
def cache_store(spark, folder):
    """Results written to the store, and those alive two hours later; each lives one hour."""
    start = 1_704_067_200
    docs = keyed(texts(spark, folder), "strict")
    written = F.timestamp_seconds(start + F.floor(F.col("doc_id") / 3) * 60)
    as_of = F.timestamp_seconds(F.lit(start + 7200))
    path = scratch_dir(spark, "store")
    entries = cache.store_entries(strict_score(docs), written, 3600)
    sinks.write_store(entries.select("cache_key", "valid", "action", "written_at", "expires_at",
                                     "expires_on"), path)
    live = cache.live_entries(sinks.read_store(spark, path, as_of).drop("expires_on"), as_of)
    minute = ((F.unix_seconds("written_at") - start) / 60).cast("long")
    return live.select("cache_key", minute.alias("minute"), "valid")


@query(f"""{sql.by_source()} SELECT guardrail AS resolved_guardrail, {sql.VALID} AS valid, count(*) AS n,
           count({sql.PROCESSED}) AS rewritten FROM f GROUP BY 1, 2""")
def verdict_sink(spark, folder):
    """Verdicts written by policy and read back."""
    path = scratch_dir(spark, "verdicts")
    verdicts = engine.validate_mixed(assigned(spark, folder)).drop("text")
    sinks.write_verdicts(verdicts, path)
    return (spark.read.parquet(path).groupBy("resolved_guardrail", "valid")
            .agg(F.count(F.lit(1)).alias("n"), F.count("processed_text").alias("rewritten")))


_AUDIT = f"""{sql.by_policy('strict')}, r AS (
    SELECT doc_id, 'length_check' AS validator_name, fl AS failed FROM f
    UNION ALL SELECT doc_id, 'toxicity_check', ft FROM f
    UNION ALL SELECT doc_id, 'sentiment_check', fs FROM f UNION ALL SELECT doc_id, 'pii_detection', fp FROM f)"""


@query(f"""{_AUDIT} SELECT validator_name, count(*) AS n, count(CASE WHEN failed THEN 1 END) AS failures
           FROM r GROUP BY 1""")
def result_sink(spark, folder):
    """Check results written by validator and read back."""
    path = scratch_dir(spark, "results")
    sinks.write_results(engine.validator_results(engine.validate(texts(spark, folder), "strict"), "doc_id"), path)
    return (spark.read.parquet(path).groupBy("validator_name")
            .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "fail", 1)).alias("failures")))


@query(f"""{_AUDIT} SELECT strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INT), '%Y-%m-%d') AS audit_day,
           count(*) AS n, count(CASE WHEN failed THEN 1 END) AS failures
           FROM r WHERE doc_id % 30 >= 15 GROUP BY 1""")
def audit_retention(spark, folder):
    """The audit trail of a month, rewritten without its first half."""
    path, kept = scratch_dir(spark, "audit"), scratch_dir(spark, "audit-kept")
    results = engine.validator_results(engine.validate(texts(spark, folder), "strict"), "doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    sinks.append_audit(results.withColumn("audit_date", day), path)
    trail = sinks.retain_audit(spark, path, kept, F.lit("2024-01-16").cast("date"))
    return (trail.groupBy(F.date_format("audit_date", "yyyy-MM-dd").alias("audit_day"))
            .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "fail", 1)).alias("failures")))


# ---- batches --------------------------------------------------------------------------------------

def _batches(spark, folder, size: int) -> DataFrame:
    """Documents as batch requests of up to ``size`` texts, by id; a batch is bounded by its size."""
    docs = tables.documents(spark, folder).select("doc_id", "text", "lang")
    return (docs.groupBy(F.floor(F.col("doc_id") / size).alias("batch_id"))
            .agg(F.array_sort(F.collect_list(F.struct("doc_id", "text", "lang"))).alias("rows"))
            .select("batch_id", F.col("rows.text").alias("texts"), F.col("rows.lang").alias("langs")))


def _batch_sql(size: int) -> str:
    return (f"b AS (SELECT doc_id, doc_id // {size} AS batch_id, text, lang, CAST(row_number() OVER "
            f"(PARTITION BY doc_id // {size} ORDER BY doc_id) - 1 AS INT) AS pos FROM documents)")


@query(f"WITH {_batch_sql(50)} SELECT batch_id, pos, md5(text) AS text_md5 FROM b")
def batch_texts(spark, folder):
    rows = tables.batch_texts(_batches(spark, folder, 50).select("batch_id", "texts"))
    return rows.select("batch_id", "pos", F.md5("text").alias("text_md5"))


@query(f"""WITH {_batch_sql(50)} SELECT batch_id, pos, md5(text) AS text_md5,
           CASE WHEN pos < 20 THEN lang END AS context FROM b""")
def batch_contexts(spark, folder):
    """Texts with contexts where a batch has only twenty contexts: the others get none."""
    some = _batches(spark, folder, 50).withColumn("contexts", F.slice("langs", 1, 20))
    rows = tables.texts_with_contexts(some)
    return rows.select("batch_id", "pos", F.md5("text").alias("text_md5"), "context")


@query(f"""WITH {_batch_sql(100)} SELECT batch_id, pos, CAST(pos // 32 AS BIGINT) AS chunk,
           'batch_' || batch_id || '_' || (pos // 32) * 32 AS request_id FROM b""")
def batch_chunks(spark, folder):
    """Chunks of 32 within a batch share a request id."""
    rows = tables.batch_texts(_batches(spark, folder, 100).select("batch_id", "texts"))
    return rows.select("batch_id", "pos", engine.chunk_of(F.col("pos")).alias("chunk"),
                       engine.batch_request_id(F.col("batch_id"), F.col("pos")).alias("request_id"))


@query(f"""{sql.by_policy('batch_optimized')}, h AS (SELECT *, {sql.VALID} AS valid,
             row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS hit FROM f)
           SELECT source, count(*) AS total_processed, count(CASE WHEN valid THEN 1 END) AS total_valid,
                  count(CASE WHEN hit THEN 1 END) AS cache_hits, count(CASE WHEN NOT hit THEN 1 END) AS cache_misses
           FROM h GROUP BY source""")
def batch_summary(spark, folder):
    """Summary per source: processed, valid, hits among the copies of a text, misses."""
    docs = keyed(texts(spark, folder, "source"), "batch_optimized")
    verdicts = engine.validate(docs, "batch_optimized").select("doc_id", "source", "cache_key", "valid")
    return engine.batch_summary(cache.with_cache_hit(verdicts, "doc_id"), "source")


_BATCH_REASON = ("CASE WHEN length(text) < 1 THEN 'empty_text' WHEN length(text) > 50000 THEN 'text_too_long' "
                 "WHEN length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) "
                 "|| chr(8195) || chr(12288))) = 0 THEN 'blank_text' END")


@query(f"""{sql.by_policy('batch_optimized')},
    b AS (SELECT doc_id, text, {sql.VALID} AS ok, {sql.ACTION} AS act, {_BATCH_REASON} AS reason,
                 doc_id // 60 - CASE WHEN doc_id // 60 % 10 = 9 THEN 1 ELSE 0 END AS batch_id FROM f),
    n AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY batch_id) AS size
          FROM b),
    s AS (SELECT DISTINCT text AS known FROM documents WHERE {_NUMBER} < 10),
    a AS (SELECT n.*, reason IS NULL AND (known IS NOT NULL OR row_number() OVER (
                     PARTITION BY text, reason IS NULL ORDER BY batch_id, pos) > 1) AS hit
          FROM n LEFT JOIN s ON text = known WHERE size <= 100)
    SELECT batch_id, 'success' AS status, 'Batch validation completed: ' || count(*) || ' texts processed' AS message,
           count(*) AS total_processed, count(CASE WHEN ok AND reason IS NULL THEN 1 END) AS total_valid,
           count(CASE WHEN hit THEN 1 END) AS cache_hits, count(CASE WHEN NOT hit THEN 1 END) AS cache_misses,
           string_agg(CASE WHEN reason IS NULL THEN act ELSE reason END, ',' ORDER BY pos) AS results
    FROM a GROUP BY batch_id
    UNION ALL SELECT DISTINCT batch_id, 'failure', 'Invalid request: batch_size', NULL, NULL, NULL, NULL, NULL FROM n WHERE size > 100""")
def batch_validation(spark, folder):
    """Batch requests of up to 120 texts, of which those beyond 100 are turned away, answered with totals and in order."""
    number = F.floor(F.col("doc_id") / 60)
    docs = tables.documents(spark, folder).select("doc_id", "text", "source")
    batches = (docs.groupBy((number - F.when(number % 10 == 9, 1).otherwise(0)).alias("batch_id"))
               .agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("rows"))
               .select("batch_id", F.col("rows.text").alias("texts"), F.lit("batch_optimized").alias("guardrail"),
                       F.lit(300).alias("cache_ttl"), F.lit(False).alias("skip_cache")))
    earlier = (docs.where(source_number() < 10)
               .select("doc_id", "text", F.lit("batch_optimized").alias("guardrail"), F.lit(300).alias("cache_ttl"),
                       F.lit(False).alias("skip_cache")))
    stored = requests.admitted(earlier).groupBy("cache_key", "resolved", "text").agg(F.min("doc_id").alias("doc_id"))
    live = requests.scorer()(stored).select("cache_key", *requests.RESULTS)
    answered = requests.answer_batches(batches, live)
    results = F.transform("results", lambda r: F.coalesce(r["reject_reason"], r["action"]))
    return answered.select("batch_id", "status", "message", "total_processed", "total_valid", "cache_hits", "cache_misses",
                           F.array_join(results, ",").alias("results"))
