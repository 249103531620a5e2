"""Queries on request logs: counters, histograms, limits, alerts, health, traces, log sources.

The event table stands for the request log: its type is the endpoint, its value the duration in
seconds, an ``error`` event a failed request, and ``k`` of its properties a usage in percent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators import alerts as alerting
from wardline.operators import cache, metrics, quantiles, ratelimit, tracing
from wardline.plans.catalog import query
from wardline.session import scratch_dir
from wardline.sources import logs, sinks, tables

HOUR = 3600 * cache.SECOND


def log(spark, folder, *columns: str) -> DataFrame:
    """The request log with its derived fields; Spark reads only the columns that are used."""
    return tables.events(spark, folder).select(
        "event_id", "ts", "user_id", F.col("event_type").alias("endpoint"), F.col("value").alias("duration"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.get_json_object("props", "$.k").cast("int").alias("usage"),
        F.unix_micros("ts").alias("micros"))


_LOG = """l AS (SELECT event_id, ts, user_id, event_type AS endpoint, value AS duration,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
    CAST(regexp_extract(props, '[0-9]+') AS INT) AS usage, epoch_us(ts) AS micros FROM events)"""


# ---- counters, histograms, gauges -----------------------------------------------------------------

@query(f"""WITH {_LOG} SELECT endpoint, status_code, count(*) AS n FROM l GROUP BY 1, 2""")
def request_counter(spark, folder):
    return metrics.counter(log(spark, folder), "endpoint", "status_code")


_LABELS = f"""WITH {_LOG}, g AS (SELECT *, CASE WHEN usage % 4 = 0 THEN 'GET' ELSE 'POST' END AS method,
    (['default','strict','permissive'])[user_id % 3 + 1] AS guardrail_name,
    (['toxicity_check','sentiment_check','pii_detection'])[event_id % 3 + 1] AS validator_name,
    (['lexicon-toxicity-1','lexicon-sentiment-1','pattern-pii-1'])[event_id % 3 + 1] AS model_name,
    (['lexicon','lexicon','pattern'])[event_id % 3 + 1] AS model_type FROM l)"""


def labelled(spark, folder) -> DataFrame:
    """The request log with the labels of its metrics, drawn from its ids."""
    def pick(values: str, number: Column) -> Column:
        return F.element_at(F.split(F.lit(values), " "), (number % 3 + 1).cast("int"))

    return log(spark, folder).withColumns({
        "method": F.when(F.col("usage") % 4 == 0, "GET").otherwise("POST"),
        "guardrail_name": pick("default strict permissive", F.col("user_id")),
        "validator_name": pick("toxicity_check sentiment_check pii_detection", F.col("event_id")),
        "model_name": pick("lexicon-toxicity-1 lexicon-sentiment-1 pattern-pii-1", F.col("event_id")),
        "model_type": pick("lexicon lexicon pattern", F.col("event_id"))})


@query(f"""{_LABELS} SELECT method, endpoint, CAST(status_code AS VARCHAR) AS status_code, guardrail_name, count(*) AS n FROM g GROUP BY ALL""")
def request_labels(spark, folder):
    """Requests by method, endpoint, status and policy."""
    return metrics.counter(labelled(spark, folder).withColumn("status_code", F.col("status_code").cast("string")),
                           "method", "endpoint", "status_code", "guardrail_name")


@query(f"""{_LABELS}, v AS (SELECT *, duration / 16 AS d FROM g),
    t AS (SELECT model_name, model_type, validator_name, count(*) AS observations,
                 CAST(sum(CAST(d AS DECIMAL(18, 9))) AS DOUBLE) AS total FROM v GROUP BY 1, 2, 3),
    b(bound, le) AS (VALUES (0.01::DOUBLE, '0.01'), (0.05, '0.05'), (0.1, '0.1'), (0.5, '0.5'), (1.0, '1.0'), (2.5, '2.5'),
                            (5.0, '5.0'), (10.0, '10.0'), ('infinity', '+Inf'))
    SELECT t.*, le, (SELECT count(*) FROM v WHERE v.model_name = t.model_name AND d <= bound) AS cumulative FROM t, b""")
def inference_labels(spark, folder):
    """Inference times by model, kind of model and validator."""
    calls = labelled(spark, folder).withColumn("d", F.col("duration") / 16)
    return metrics.histogram(calls, "d", metrics.INFERENCE_BUCKETS, "model_name", "model_type", "validator_name")


def _histogram_sql(buckets: list[float], scale: str) -> str:
    rows = ", ".join(f"({bound}::DOUBLE, '{bound}')" for bound in buckets)
    return f"""WITH {_LOG}, v AS (SELECT endpoint, {scale} AS d FROM l), b(bound, le) AS (VALUES {rows}),
        t AS (SELECT endpoint, count(*) AS observations,
                     CAST(sum(CAST(d AS DECIMAL(18, 9))) AS DOUBLE) AS total FROM v GROUP BY 1)
        SELECT t.endpoint, le, (SELECT count(*) FROM v WHERE v.endpoint = t.endpoint AND d <= bound) AS cumulative,
               observations, total FROM t, b
        UNION ALL SELECT endpoint, '+Inf', observations, observations, total FROM t"""


@query(_histogram_sql([0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0], "duration"))
def duration_histogram(spark, folder):
    return metrics.histogram(log(spark, folder), "duration", metrics.REQUEST_BUCKETS, "endpoint")


@query(_histogram_sql([0.01, 0.05, 0.1, 0.5, 1.0, 2.5, 5.0], "duration / 64"))
def validation_histogram(spark, folder):
    """A 64th of each request's time stands for the time of one check."""
    checks = log(spark, folder).withColumn("d", F.col("duration") / 64)
    return metrics.histogram(checks, "d", metrics.VALIDATION_BUCKETS, "endpoint")


@query(_histogram_sql([0.01, 0.05, 0.1, 0.5, 1.0, 2.5, 5.0, 10.0], "duration / 16"))
def inference_histogram(spark, folder):
    """A 16th of each request's time stands for model inference."""
    calls = log(spark, folder).withColumn("d", F.col("duration") / 16)
    return metrics.histogram(calls, "d", metrics.INFERENCE_BUCKETS, "endpoint")


@query(_histogram_sql([1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0], "duration * 2"))
def model_load_histogram(spark, folder):
    """Twice each request's time stands for loading a model."""
    loads = log(spark, folder).withColumn("d", F.col("duration") * 2)
    return metrics.histogram(loads, "d", metrics.MODEL_LOAD_BUCKETS, "endpoint")


@query(f"""WITH {_LOG}, c AS (
      SELECT endpoint, micros // 1000000 AS second, 1 AS change FROM l UNION ALL
      SELECT endpoint, (micros + CAST(round(duration * 1000000) AS BIGINT)) // 1000000, -1 FROM l),
    n AS (SELECT endpoint, second, CAST(sum(change) AS BIGINT) AS net FROM c GROUP BY 1, 2)
    SELECT endpoint, second, net, CAST(sum(net) OVER (PARTITION BY endpoint ORDER BY second) AS BIGINT) AS active FROM n""")
def active_connections(spark, folder):
    """Open requests per endpoint after each second in which one starts or ends."""
    requests = log(spark, folder).select(
        "endpoint", F.floor(F.col("micros") / cache.SECOND).alias("start"),
        F.floor((F.col("micros") + F.round(F.col("duration") * cache.SECOND).cast("long")) / cache.SECOND)
        .alias("end"))
    return metrics.connection_load(requests, "start", "end", "endpoint")


@query(f"""WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY micros DESC, event_id DESC) AS k FROM l)
           SELECT endpoint, usage AS value FROM r WHERE k = 1""")
def gauge_last(spark, folder):
    """Last reported usage per endpoint."""
    return metrics.last_values(log(spark, folder), "usage", "micros", "event_id", "endpoint")


@query(f"""WITH {_LOG} SELECT endpoint, count(*) AS requests,
           round(CAST(sum(CAST(duration AS DECIMAL(18, 9))) AS DOUBLE) / count(*), 6) AS mean,
           round(quantile_cont(duration, 0.95), 6) AS p95, round(quantile_cont(duration, 0.99), 6) AS p99,
           round(count(*) / CAST((max(micros) // 1000000 - min(micros) // 1000000) AS DOUBLE), 6) AS throughput
           FROM l GROUP BY 1""")
def latency_stats(spark, folder):
    requests = log(spark, folder).withColumn("second", F.floor(F.col("micros") / cache.SECOND))
    stats = metrics.latency_stats(requests, "duration", "second", "endpoint")
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "p95", "p99", "throughput")})


@query(f"""WITH {_LOG} SELECT endpoint, unnest([0.5::DOUBLE, 0.95, 0.99]) AS probability, count(*) AS requests, true AS within
           FROM l WHERE isfinite(duration) GROUP BY 1""")
def latency_sketch(spark, folder):
    """Tail latency from stored hourly sketches, merged to the whole period: its ranks are within one percent."""
    requests, path = log(spark, folder), scratch_dir(spark, "sketches")
    hourly = quantiles.quantile_sketches(
        requests.withColumn("hour", F.floor(F.col("micros") / HOUR)), ["endpoint", "hour"], "duration")
    sinks.write_sketches(hourly.withColumn("day", F.floor(F.col("hour") / 24)), path)
    merged = quantiles.merged_quantiles(spark.read.parquet(path), ["endpoint"], [0.5, 0.95, 0.99])
    return quantiles.rank_errors(requests, ["endpoint"], "duration", merged).select(
        "endpoint", "probability", F.col("n").alias("requests"), (F.col("rank_error") <= 0.01).alias("within"))


@query(f"""WITH {_LOG} SELECT strftime(ts, '%Y-%m-%d') AS day,
           round(avg(CASE WHEN status_code >= 500 THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM l GROUP BY 1""")
def error_rate(spark, folder):
    return (log(spark, folder).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
            .agg(F.round(metrics.error_rate(F.col("status_code") >= 500), 6).alias("error_rate")))


@query(f"""WITH {_LOG} SELECT epoch_us(date_trunc('hour', ts)) AS window_start, endpoint, count(*) AS n,
           CAST(sum(CAST(duration AS DECIMAL(18, 9))) AS DOUBLE) AS total FROM l GROUP BY 1, 2""")
def metric_windows(spark, folder):
    """Requests and total time per hour and endpoint."""
    series = metrics.windowed(log(spark, folder), "ts", "1 hour", "duration", "endpoint")
    return series.select(F.unix_micros("window_start").alias("window_start"), "endpoint", "n", "total")


@query(f"""WITH {_LOG}, g AS (SELECT user_id, micros, CASE WHEN micros - lag(micros) OVER w <= 1800000000 THEN 0 ELSE 1 END AS fresh
                              FROM l WINDOW w AS (PARTITION BY user_id ORDER BY micros)),
    s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY micros) AS BIGINT) AS session FROM g)
    SELECT user_id, session, min(micros) AS first_micros, max(micros) AS last_micros, count(*) AS requests
    FROM s GROUP BY 1, 2""")
def sessions(spark, folder):
    """Activity of each user, cut at pauses of more than half an hour."""
    return metrics.sessions(log(spark, folder), "user_id", "micros")


# ---- rate limits ----------------------------------------------------------------------------------

@query(f"""WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY endpoint, micros // 1000000 // 3600
                                                          ORDER BY micros // 1000000, event_id) AS k FROM l)
           SELECT event_id, micros // 1000000 // 3600 AS "window", k > 2 AS rejected FROM r""")
def rate_limit_fixed(spark, folder):
    """Requests beyond two per endpoint and hour."""
    seconds = log(spark, folder).withColumn("second", F.floor(F.col("micros") / cache.SECOND))
    return (ratelimit.rejected_requests(seconds, ["endpoint"], "second", "event_id", limit=2, window=3600)
            .select("event_id", "window", "rejected"))


@query(f"""WITH {_LOG}, c AS (SELECT user_id, micros // 60000000 AS "window", count(*) AS requests FROM l GROUP BY 1, 2)
           SELECT user_id, "window", requests, least(requests, 1) AS admitted, greatest(requests - 1, 0) AS rejected
           FROM c WHERE requests > 1""")
def rate_limit_summary(spark, folder):
    """Users with more than one request in a minute, and how many were too many."""
    seconds = log(spark, folder).withColumn("second", F.floor(F.col("micros") / cache.SECOND))
    out = ratelimit.limit_summary(seconds, ["user_id"], "second", limit=1)
    return out.where(F.col("rejected") > 0).withColumns(
        {c: F.col(c).cast("long") for c in ("admitted", "rejected")})


@query(f"""WITH {_LOG}, s AS (SELECT endpoint, micros // 1000000 AS second, count(*) AS requests FROM l GROUP BY 1, 2)
           SELECT endpoint, second, requests, CAST(sum(requests) OVER (PARTITION BY endpoint ORDER BY second
             RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS BIGINT) AS load FROM s""")
def rate_limit_sliding(spark, folder):
    """Load of each endpoint in the ten minutes before every request."""
    seconds = log(spark, folder).withColumn("second", F.floor(F.col("micros") / cache.SECOND))
    return ratelimit.sliding_load(seconds, ["endpoint"], "second", window=600)


# ---- alerts and health ----------------------------------------------------------------------------

def _daily(spark, folder) -> DataFrame:
    """The alert metrics of each day. Usage is turned into a fraction."""
    requests = log(spark, folder).withColumn("day", F.floor(F.col("micros") / (24 * HOUR)))
    basic = requests.groupBy("day").agg(
        metrics.error_rate(F.col("status_code") >= 500).alias("error_rate"),
        (F.max("usage") / 100).alias("memory_usage"),
        (F.sum("usage") / F.count("usage") / 100).alias("cpu_usage"))
    tail = metrics.exact_quantiles(requests, ["day"], "duration", [0.95]).select(
        "day", F.col("quantile").alias("response_time_p95"))
    reuse = (cache.replay_refreshing(requests, ["user_id", "endpoint"], ttl=3600)
             .groupBy(F.floor(F.col("slice") / 24).alias("day"))
             .agg(metrics.hit_ratio(F.sum("hits"), F.sum("requests") - F.sum("hits")).alias("cache_hit_ratio")))
    return basic.join(tail, "day", "left").join(reuse, "day", "left")  # a day without durations keeps its other alerts


@query(f"""WITH {_LOG}, d AS (SELECT *, micros // 86400000000 AS day,
             micros - lag(micros) OVER (PARTITION BY user_id, endpoint ORDER BY micros) AS gap FROM l),
    w AS (SELECT day, avg(CASE WHEN status_code >= 500 THEN 1.0 ELSE 0.0 END) AS error_rate,
                 max(usage) / 100.0::DOUBLE AS memory_usage, sum(usage) / CAST(count(*) AS DOUBLE) / 100 AS cpu_usage,
                 quantile_cont(duration, 0.95) AS response_time_p95,
                 count(CASE WHEN gap <= 3600000000 THEN 1 END) / CAST(count(*) AS DOUBLE) AS cache_hit_ratio
          FROM d GROUP BY day),
    u AS (SELECT day, 'error_rate' AS metric, error_rate AS value, 0.05::DOUBLE AS threshold, true AS above FROM w
          UNION ALL SELECT day, 'memory_usage', memory_usage, 0.9, true FROM w
          UNION ALL SELECT day, 'cpu_usage', cpu_usage, 0.9, true FROM w
          UNION ALL SELECT day, 'response_time_p95', response_time_p95, 5.0, true FROM w
          UNION ALL SELECT day, 'cache_hit_ratio', cache_hit_ratio, 0.7, false FROM w)
    SELECT day, metric, round(value, 6) AS value, threshold,
           CASE WHEN above THEN metric || ' exceeded threshold: ' || printf('%.3f', value) || ' > ' || threshold
                ELSE metric || ' fell below threshold: ' || printf('%.3f', value) || ' < ' || threshold END AS message
    FROM u WHERE CASE WHEN above THEN value > threshold ELSE value < threshold END""")
def alerts(spark, folder):
    """Daily metrics beyond their thresholds."""
    values = alerting.unpivot_metrics(_daily(spark, folder), ["day"], list(alerting.ALERT_THRESHOLDS))
    return alerting.alerts(values).withColumn("value", F.round("value", 6))


@query(f"""WITH {_LOG}, h AS (SELECT micros // 3600000000 AS hour, max(usage) AS memory, min(usage) + 80 AS cpu,
             count(CASE WHEN status_code >= 500 THEN 1 END) <= 4 AS up FROM l GROUP BY 1),
    e AS (SELECT hour, concat_ws(';', CASE WHEN memory > 90 THEN 'High memory usage detected' END,
             CASE WHEN cpu > 90 THEN 'High CPU usage detected' END, CASE WHEN NOT up THEN 'Cache connection failed' END)
             AS errors, (memory > 90)::INT + (cpu > 90)::INT + (NOT up)::INT AS n_errors FROM h)
    SELECT hour, errors, n_errors, CASE WHEN n_errors = 0 THEN 'healthy' WHEN n_errors < 3 THEN 'degraded'
           ELSE 'unhealthy' END AS status FROM e""")
def health_tier(spark, folder):
    """Health per hour from usage and failures."""
    hours = log(spark, folder).groupBy(F.floor(F.col("micros") / HOUR).alias("hour")).agg(
        F.max("usage").alias("memory"), (F.min("usage") + 80).alias("cpu"),
        (F.count(F.when(F.col("status_code") >= 500, 1)) <= 4).alias("up"))
    errors = hours.select("hour", alerting.health_errors(F.col("memory"), F.col("cpu"), F.col("up")).alias("errors"))
    n_errors = F.when(F.col("errors") == "", 0).otherwise(F.size(F.split("errors", ";")))
    return errors.withColumn("n_errors", n_errors).withColumn("status", alerting.health_tier(F.col("n_errors")))


# ---- traces ---------------------------------------------------------------------------------------

def _spans(spark, folder) -> DataFrame:
    """A span per request, with the tags and logs a service would set."""
    requests = log(spark, folder)
    seconds = F.col("start_micros") / cache.SECOND
    tags = F.create_map(F.lit("method"), F.lit("POST"), F.lit("url"), F.lit("unknown"))
    none = F.lit(None).cast("array<struct<timestamp:double,level:string,message:string>>")
    begun = tracing.add_log(none, seconds, F.lit("started"))
    failed = tracing.add_log(begun, seconds, F.concat(F.lit("Request failed: "), "status_code"), "error")
    return (requests.select(
        F.concat(F.lit("trace-"), "user_id").alias("trace_id"), F.concat(F.lit("span-"), "event_id").alias("span_id"),
        F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("span-"), F.col("event_id") - 1)).alias("parent_id"),
        F.concat(F.lit("req_"), F.floor(F.col("event_id") / 10).cast("string")).alias("request_id"),
        F.col("micros").alias("start_micros"),
        (F.col("micros") + F.round(F.col("duration") * cache.SECOND).cast("long")).alias("end_micros"),
        tracing.set_tag(tags, "url", F.col("endpoint")).alias("tags"), "status_code")
        .withColumn("logs", F.when(F.col("status_code") >= 500, failed).otherwise(begun)))


@query(f"""WITH {_LOG} SELECT 'span-' || event_id AS span_id,
           round(CAST(round(duration * 1000000) AS BIGINT) / 1000.0::DOUBLE, 6) AS duration_ms FROM l""")
def span_durations(spark, folder):
    return tracing.with_duration(_spans(spark, folder)).select("span_id", F.round("duration_ms", 6).alias("duration_ms"))


@query(f"""WITH {_LOG} SELECT 'span-' || event_id AS span_id, 'method=POST;url=' || endpoint AS tags,
           CASE WHEN status_code >= 500 THEN 'info:started;error:Request failed: 500' ELSE 'info:started' END AS logs FROM l""")
def span_tags(spark, folder):
    entries = F.transform("logs", lambda e: F.concat(e["level"], F.lit(":"), e["message"]))
    return _spans(spark, folder).select("span_id", tracing.flat_tags(F.col("tags")).alias("tags"),
                                        F.array_join(entries, ";").alias("logs"))


@query(f"""WITH {_LOG}, r AS (SELECT event_id // 10 AS q, min(micros) AS received, count(*) AS calls FROM l
             WHERE (event_id // 10) % 4 <> 3 GROUP BY 1)
           SELECT 'span-' || event_id AS span_id, 'trace-' || user_id AS trace_id,
                  CASE WHEN event_id % 2 = 1 THEN 'span-' || (event_id - 1) END AS parent_id,
                  'req_' || event_id // 10 AS request_id, calls, micros - received AS waited
           FROM l LEFT JOIN r ON q = event_id // 10""")
def span_requests(spark, folder):
    """Spans with the request they belong to; some requests were not recorded."""
    spans = _spans(spark, folder)
    number = F.floor(F.col("event_id") / 10)
    requests = (log(spark, folder).where(number % 4 != 3)
                .groupBy(F.concat(F.lit("req_"), number.cast("string")).alias("request_id"))
                .agg(F.min("micros").alias("received"), F.count(F.lit(1)).alias("calls")))
    return tracing.with_requests(spans, requests).select(
        "span_id", "trace_id", "parent_id", "request_id", "calls",
        (F.col("start_micros") - F.col("received")).alias("waited"))


@query(f"""WITH {_LOG} SELECT endpoint, count(*) AS spans,
           round(CAST(sum(CAST(round(duration * 1000000) AS BIGINT)) AS DOUBLE) / 1000, 3) AS total_ms FROM l GROUP BY 1""")
def span_sink(spark, folder):
    """Finished spans written and read back."""
    path = scratch_dir(spark, "spans")
    sinks.write_spans(tracing.with_duration(_spans(spark, folder)), path)
    micros = F.sum(F.round(F.col("duration_ms") * 1000).cast("long"))
    return (spark.read.parquet(path).groupBy(F.col("tags")["url"].alias("endpoint"))
            .agg(F.count(F.lit(1)).alias("spans"), F.round(micros / 1000, 3).alias("total_ms")))


@query(_histogram_sql([0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0], "duration")
       .replace("SELECT t.endpoint, le, (", "SELECT 'guardrails_request_duration_seconds' AS metric, t.endpoint, le, (")
       .replace("observations, total FROM t, b", "FROM t, b").replace("AS cumulative,", "AS value")
       .replace("SELECT endpoint, '+Inf', observations, observations, total FROM t",
                "SELECT 'guardrails_request_duration_seconds', endpoint, '+Inf', observations FROM t"))
def metrics_sink(spark, folder):
    """Histogram samples written as metrics and read back."""
    path = scratch_dir(spark, "metrics")
    samples = metrics.histogram(log(spark, folder), "duration", metrics.REQUEST_BUCKETS, "endpoint").select(
        F.lit("guardrails_request_duration_seconds").alias("metric"),
        F.create_map(F.lit("endpoint"), F.col("endpoint")).alias("labels"), "le", F.col("cumulative").alias("value"))
    sinks.write_metrics(samples, path)
    return spark.read.parquet(path).select("metric", F.col("labels")["endpoint"].alias("endpoint"), "le", "value")


# ---- log sources ----------------------------------------------------------------------------------

@query(f"""WITH {_LOG} SELECT 'POST /' || endpoint || ' HTTP/1.1' AS request, status_code AS status, count(*) AS n,
           CAST(sum(usage * 10) AS BIGINT) AS bytes, CAST(sum(CAST(duration AS DECIMAL(18, 9))) AS DOUBLE) AS request_time,
           count(CASE WHEN usage % 2 = 0 THEN 1 END) AS upstream, max(micros // 1000000) AS last_second,
           0::BIGINT AS malformed FROM l GROUP BY 1, 2
    UNION ALL SELECT NULL, NULL, count(*), NULL, NULL, 0, NULL, count(*) FROM events WHERE event_id % 97 = 0 HAVING count(*) > 0""")
def access_log(spark, folder):
    """The request log written as access-log lines, some broken ones among them, and parsed again."""
    r = log(spark, folder)
    upstream = F.when(F.col("usage") % 2 == 0, F.col("duration").cast("string")).otherwise("-")
    line = F.concat(
        F.lit("10.0.0."), F.col("user_id") % 250, F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss Z"),
        F.lit('] "POST /'), "endpoint", F.lit(' HTTP/1.1" '), "status_code", F.lit(" "), F.col("usage") * 10,
        F.lit(' "-" "client" "-" rt='), F.col("duration").cast("string"), F.lit(' uct="0.001" uht="0.002" urt="'),
        upstream, F.lit('"'))
    broken = r.where(F.col("event_id") % 97 == 0).select(F.lit("cut off [01/Jan").alias("value"))
    path = scratch_dir(spark, "access-log")
    r.select(line.alias("value")).unionAll(broken).write.text(path)
    return logs.access_log(spark, path).groupBy("request", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"),
        metrics.exact_sum(F.col("request_time")).alias("request_time"), F.count("upstream_time").alias("upstream"),
        F.max(F.unix_seconds("ts")).alias("last_second"), F.count("malformed").alias("malformed"))


@query(f"""WITH {_LOG} SELECT endpoint AS event, usage % 2 = 0 AS cache_hit, count(*) AS n,
           count(CASE WHEN status_code = 200 THEN 1 END) AS valid,
           CAST(sum(CAST(duration * 1000 AS DECIMAL(18, 9))) AS DOUBLE) AS execution_time_ms FROM l GROUP BY 1, 2""")
def structured_log(spark, folder):
    """The request log written as JSON lines and read with the fixed schema."""
    path = scratch_dir(spark, "json-log")
    log(spark, folder).select(F.to_json(F.struct(
        F.col("endpoint").alias("event"), F.concat(F.lit("req_"), "event_id").alias("request_id"),
        (F.col("status_code") == 200).alias("valid"), (F.col("duration") * 1000).alias("execution_time_ms"),
        (F.col("usage") % 2 == 0).alias("cache_hit"), F.lit("ignored").alias("other"))).alias("value")).write.text(path)
    return logs.structured_log(spark, path).groupBy("event", "cache_hit").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("valid"), 1)).alias("valid"),
        metrics.exact_sum(F.col("execution_time_ms")).alias("execution_time_ms"))
