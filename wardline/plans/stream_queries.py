"""Streaming queries, run over all data present, and model plug-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import safety, scorers
from wardline.operators import cache, engine, plugins
from wardline.operators.validators import VALIDATORS, NameColumns, pii_detection
from wardline.operators.validators import toxicity_check as toxicity_validator
from wardline.plans import policies, sql
from wardline.plans.catalog import query
from wardline.plans.text_queries import texts
from wardline.schemas import DOCUMENTS, EVENTS
from wardline.session import scratch_dir, ship_package
from wardline.sources import tables
from wardline.streaming import jobs


def _event_stream(spark, folder):
    return (jobs.stream_of(spark, folder, EVENTS, "events.parquet")
            .withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())))


@query(f"""{sql.by_policy('strict')} SELECT doc_id, {sql.VALID} AS valid, {sql.ACTION} AS action,
           {sql.PROCESSED} AS processed_text FROM f""")
def stream_validate(spark, folder):
    """Documents validated as they arrive: the same rows as in batch."""
    arriving = jobs.stream_of(spark, folder, DOCUMENTS, "documents.parquet").select("doc_id", "text")
    verdicts = jobs.validated(arriving, "strict").select("doc_id", "valid", "action", "processed_text")
    return jobs.run_available(verdicts, "stream-validate")


@query("""WITH w AS (SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type, count(*) AS n,
                            CAST(sum(CAST(value AS DECIMAL(18, 9))) AS DOUBLE) AS total FROM events GROUP BY 1, 2)
          SELECT * FROM w WHERE window_start + 3600000000 <= (SELECT epoch_ms(max(ts)) * 1000 - 600000000 FROM events)""")
def stream_metrics(spark, folder):
    """Hourly counts per endpoint, for the hours no late event can reach any more."""
    series = jobs.windowed_counts(_event_stream(spark, folder), "ts", "1 hour", "10 minutes", "value", "event_type")
    return (jobs.run_available(series, "stream-metrics")
            .select(F.unix_micros("window_start").alias("window_start"), "event_type", "n", "total"))


@query()
def stream_dedup(spark, folder):
    """First request of each user and endpoint within the TTL, on a stream."""
    fresh = jobs.first_of_key(_event_stream(spark, folder), ["user_id", "event_type"])
    return jobs.run_available(fresh.select("event_id", "ts", "user_id", "event_type"), "stream-dedup").select(
        "user_id", "event_type")


@query("""WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) // 1000000 AS sec, min(event_id) AS id FROM events GROUP BY 1, 2),
    w(user_id, sec) AS (
      SELECT user_id, min(sec) FROM s GROUP BY user_id
      UNION ALL
      SELECT s.user_id, min(s.sec) FROM w JOIN s ON s.user_id = w.user_id AND s.sec >= w.sec + 21600 GROUP BY s.user_id, w.sec)
    SELECT s.id AS event_id, s.user_id, s.sec AS second FROM w JOIN s USING (user_id, sec)""")
def stream_ttl_dedup(spark, folder):
    """Requests that find no live entry of their user as they arrive, when entries live six hours."""
    arriving = _event_stream(spark, folder).select(
        "event_id", "user_id", F.floor(F.unix_micros("ts") / cache.SECOND).alias("second"))
    return jobs.first_within_ttl(arriving, ["user_id"], "second", "event_id", scratch_dir(spark, "ttl-dedup"), 21600, "1 day")


@query("""WITH s AS (SELECT event_id, event_id // 10 AS q, ts FROM events),
    r AS (SELECT event_id // 10 AS q, ts AS received FROM events WHERE event_id % 10 = 0 AND event_id // 10 % 4 <> 3),
    m AS (SELECT event_id, s.q, ts, received FROM s JOIN r ON s.q = r.q AND received <= ts AND received >= ts - INTERVAL 1 DAY)
    SELECT event_id, epoch_us(ts) - epoch_us(received) AS waited FROM m
    UNION ALL SELECT event_id, NULL FROM s WHERE event_id NOT IN (SELECT event_id FROM m)
      AND epoch_ms(ts) <= (SELECT epoch_ms(max(received)) - 600000 FROM r)""")
def stream_span_requests(spark, folder):
    """Arriving spans with the arriving requests they belong to; some requests are never recorded."""
    number = F.floor(F.col("event_id") / 10)
    spans = _event_stream(spark, folder).select("event_id", number.alias("span_request"), F.col("ts").alias("begun"))
    requests = (_event_stream(spark, folder).where((F.col("event_id") % 10 == 0) & (number % 4 != 3))
                .select(number.alias("request"), F.col("ts").alias("received")))
    joined = jobs.spans_with_requests(spans, requests, "begun", "received", "span_request", "request", "1 day")
    out = jobs.run_available(joined, "stream-spans")
    return out.select("event_id", (F.unix_micros("begun") - F.unix_micros("received")).alias("waited"))


@query(f"""{sql.by_policy('strict')} SELECT {sql.ACTION} AS action, count(*) AS n, count({sql.PROCESSED}) AS rewritten
           FROM f GROUP BY 1""")
def stream_verdict_sink(spark, folder):
    """Verdicts of arriving documents in a sink that holds the rows of a batch once, however often it is run."""
    arriving = jobs.stream_of(spark, folder, DOCUMENTS, "documents.parquet").select("doc_id", "text")
    path = scratch_dir(spark, "verdict-batches")
    verdicts = jobs.validated(arriving, "strict").select("doc_id", "valid", "action", "processed_text")
    jobs.write_each_batch(verdicts, path, "action")
    return jobs.read_batches(spark, path, verdicts.schema).groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.count("processed_text").alias("rewritten"))


@query("""WITH c AS (SELECT event_type, epoch_us(ts) // 60000000 AS minute, count(*) AS requests FROM events GROUP BY 1, 2)
          SELECT event_type, minute, requests, least(requests, 1) AS admitted, greatest(requests - 1, 0) AS rejected FROM c
          WHERE (minute + 1) * 60000000 <= (SELECT epoch_ms(max(ts)) * 1000 - 60000000 FROM events)""")
def stream_rate_limit(spark, folder):
    """Admitted and rejected requests per endpoint and minute at one request a minute, on a stream."""
    out = jobs.run_available(jobs.limited(_event_stream(spark, folder), ["event_type"], limit=1), "stream-limit")
    return out.select("event_type", F.floor(F.unix_micros("window_start") / (60 * cache.SECOND)).alias("minute"),
                      "requests", F.col("admitted").cast("long").alias("admitted"),
                      F.col("rejected").cast("long").alias("rejected"))


@query("""WITH r AS (SELECT event_id, epoch_us(ts) // 1000000 // 3600 AS "window", row_number() OVER (
                        PARTITION BY event_type, epoch_us(ts) // 1000000 // 3600 ORDER BY epoch_us(ts) // 1000000, event_id) AS k FROM events)
          SELECT event_id, "window", k > 2 AS rejected FROM r""")
def stream_rejections(spark, folder):
    """Which requests are beyond two per endpoint and hour, decided as they arrive."""
    arriving = _event_stream(spark, folder).select(
        "event_id", "event_type", F.floor(F.unix_micros("ts") / cache.SECOND).alias("second"))
    return jobs.limit_requests(arriving, ["event_type"], "second", "event_id", scratch_dir(spark, "stream-rejections"),
                               limit=2, window=3600, late="1 day").select("event_id", "window", "rejected")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh
                     FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS session FROM g),
    e AS (SELECT user_id, min(us) AS first_micros, max(us) + 1800000000 AS end_micros, count(*) AS requests FROM s GROUP BY user_id, session)
    SELECT * FROM e WHERE end_micros <= (SELECT epoch_ms(max(ts)) * 1000 - 600000000 FROM events)""")
def stream_sessions(spark, folder):
    """User sessions on a stream, once they can grow no more."""
    out = jobs.run_available(jobs.session_counts(_event_stream(spark, folder), "user_id"), "stream-sessions")
    return out.select("user_id", F.unix_micros("session_start").alias("first_micros"),
                      F.unix_micros("session_end").alias("end_micros"), "requests")


# ---- models ---------------------------------------------------------------------------------------

@query()
def ml_toxicity(spark, folder):
    """A classifier trained on the labelled documents scores all documents."""
    docs = texts(spark, folder)
    labels = tables.table(spark, folder, "labels").select("doc_id", "toxic")
    model = plugins.train_toxicity(docs.join(labels, "doc_id").select("text", "toxic"))
    return plugins.trained_scores(model, docs).select("doc_id", F.round("score", 6).alias("score"))


@query("""SELECT (SELECT count(*) FROM documents) AS scored, true AS probabilities,
          (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE labels.toxic IS NOT NULL AND doc_id % 5 <> 0) AS trained_on,
          (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE labels.toxic IS NOT NULL AND doc_id % 5 = 0) AS held_out,
          true AS ranks_toxic_higher""")
def ml_toxicity_quality(spark, folder):
    """A classifier trained on four fifths of the labelled documents: all documents get a probability, and of the
    fifth held out a toxic document scores above a clean one in more than six of ten pairs."""
    docs = texts(spark, folder)
    labelled = (docs.join(tables.table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id")
                .where(F.col("toxic").isNotNull()))
    held = F.col("doc_id") % 5 == 0
    model = plugins.train_toxicity(labelled.where(~held).select("text", "toxic"))
    area = plugins.ranking_quality(plugins.trained_scores(model, labelled.where(held)), "toxic")
    judged = plugins.trained_scores(model, docs).join(labelled.select("doc_id", "toxic"), "doc_id", "left")
    return judged.agg(
        F.count(F.lit(1)).alias("scored"), F.min(F.col("score").between(0, 1)).alias("probabilities"),
        F.count(F.when(F.col("toxic").isNotNull() & ~held, 1)).alias("trained_on"),
        F.count(F.when(F.col("toxic").isNotNull() & held, 1)).alias("held_out"),
        F.lit(area > 0.6).alias("ranks_toxic_higher"))


def word_list_model():
    """A model plug-in with the word list of the default scorer; it cannot read texts over 30000 long."""
    import re

    toxic = set(scorers.TOXIC_WORDS)

    def predict(batch):
        if any(len(text) > 30000 for text in batch):
            raise ValueError("text too long for the model")
        found = [len(toxic.intersection(re.split(r"[^a-z]+", text.lower()))) for text in batch]
        return [[("TOXIC", 1 - 0.5 ** n), ("NON_TOXIC", 0.5 ** n)] for n in found]

    return predict


@query(rf"""WITH {sql.measures('documents', 'doc_id')},
    k AS (SELECT doc_id, n > 30000 AS broken, 1 - pow(0.5, len(list_intersect(
             regexp_split_to_array(lower(text), '[^a-z]+'), {sql.TOXIC}))) AS s FROM m)
    SELECT doc_id, NOT (broken OR s > 0.7) AS valid,
           CASE WHEN broken THEN NULL WHEN s > 0.7 THEN s ELSE 1 - s END AS confidence,
           CASE WHEN broken THEN 'Toxicity validation error: text too long for the model'
                WHEN s > 0.7 THEN 'Toxicity detected (confidence: ' || printf('%.3f', s) || ')'
                ELSE 'No toxicity detected' END AS message FROM k""")
def model_plugin(spark, folder):
    """A Python model as toxicity scorer; texts it cannot read fail closed."""
    ship_package(spark)
    models = plugins.ModelRegistry()
    models.register("words", "word-list", word_list_model)
    scored = texts(spark, folder).withColumn("m", models.scores(F.col("text"), "words", "word-list"))
    docs = scored.select("doc_id", "text", scorers.toxicity_of_labels(F.col("m.labels")).alias("s"),
                         F.col("m.error").alias("e"))
    known = VALIDATORS.with_validator(toxicity_validator(scorers.ScoreColumns("s", "word-list-1", "e")))
    registry = {"default": policies.Policy("default", "toxicity", (policies.CheckSpec("toxicity_check", None, 0.7),))}
    check = F.col("validations")[0]
    return (engine.validate(docs, registry=registry, validators=known)
            .select("doc_id", "valid", check["confidence"].alias("confidence"), check["message"].alias("message")))


def listed_names_model():
    """A recognizer plug-in that knows two names; it cannot read texts over 30000 long."""
    def predict(batch):
        if any(len(text) > 30000 for text in batch):
            raise ValueError("text too long for the model")
        return [[(label, name) for label, name in (("ORG", "Apache"), ("GPE", "License")) if name in text]
                for text in batch]

    return predict


@query(f"""WITH {sql.measures('documents', 'doc_id')},
    k AS (SELECT doc_id, n > 30000 AS broken, len(ents) > 0 OR contains(text, 'Apache') OR contains(text, 'License') AS hit, ents, text,
                 replace(replace(redacted, 'License', '[LOCATION_REDACTED]'), 'Apache', '[ORGANIZATION_REDACTED]') AS r FROM m)
    SELECT doc_id, NOT (broken OR hit) AS valid, CASE WHEN broken OR hit THEN 'filter' ELSE 'pass' END AS action,
           CASE WHEN broken THEN 'PII validation error: text too long for the model'
                WHEN hit THEN 'PII detected' ELSE 'No PII detected' END AS message,
           CASE WHEN hit AND NOT broken THEN md5(r) END AS redacted_md5 FROM k""")
def pii_plugin(spark, folder):
    """A Python recognizer beside the patterns, with spelled-out tags; texts it cannot read fail closed."""
    ship_package(spark)
    named = texts(spark, folder).withColumn(
        "m", plugins.model_names(F.col("text"), "listed-names", listed_names_model)).select(
        "doc_id", "text", F.col("m.names").alias("names"), F.col("m.error").alias("e"))
    known = VALIDATORS.with_validator(pii_detection(
        friendly=True, recognizer=NameColumns("names", "listed-names-1", "e")))
    registry = {"default": policies.Policy("default", "", (policies.CheckSpec("pii_detection", on_fail="filter"),))}
    check = F.col("validations")[0]
    return engine.validate(named, registry=registry, validators=known).select(
        "doc_id", "valid", "action",
        F.when(F.col("e").isNull(), F.substring_index(check["message"], ": ", 1)).otherwise(check["message"])
        .alias("message"), F.when(F.col("e").isNull(), F.md5(check["redacted_text"])).alias("redacted_md5"))


def one_word_model():
    """A safety model plug-in that answers by the first category word it meets."""
    def predict(prompts):
        return ["unsafe: violence" if "harm" in p.lower() else "unsafe: hate" if "hate" in p.lower() else "safe"
                for p in prompts]

    return predict


@query("""WITH a AS (SELECT conv_id, turn, contains(lower(text), 'harm') AS h, contains(lower(text), 'hate') AS t FROM conversations)
          SELECT conv_id, turn, NOT (h OR t) AS is_safe, CASE WHEN h THEN 'Detected violence content'
                 WHEN t THEN 'Detected hate_speech content' ELSE '' END AS violations FROM a""")
def safety_plugin(spark, folder):
    """A Python safety model whose worded answers are parsed."""
    ship_package(spark)
    answered = tables.conversations(spark, folder).withColumn(
        "m", plugins.model_verdicts(safety.prompt(F.col("text"), F.lit("user_input")), "one-word", one_word_model))
    return (answered.withColumn("v", safety.parsed(F.col("m.raw"), F.col("m.error")))
            .select("conv_id", "turn", "v.is_safe", F.concat_ws(";", "v.violations").alias("violations")))
