"""Queries over documents: admission, validators, policies, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import markup, pii, scorers
from wardline.functions.arrays import computed_once, exploded
from wardline.operators import admission, engine, metrics
from wardline.operators.canary import arm
from wardline.operators.gazetteer import with_entities, with_names
from wardline.operators.validators import (
    VALIDATORS, Measures, NameColumns, Outcome, Params, Validator, pii_detection,
)
from wardline.operators.validators import toxicity_check as toxicity_validator
from wardline.plans import policies, sql
from wardline.plans.catalog import query
from wardline.session import spread
from wardline.sources import tables

REQUESTED_NAMES = ["default", "strict", "permissive", "content_moderation", "customer_service",
                   "batch_optimized", "unlisted"]


def texts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Documents for scoring: only the needed columns, on all cores."""
    return spread(tables.documents(spark, folder).select("doc_id", "text", *columns), "doc_id")


def requested_guardrail() -> Column:
    """The policy a document asks for, by its source; the last name is in no registry."""
    number = F.substring("source", 4, 9).cast("int") % len(REQUESTED_NAMES)
    return F.element_at(F.array(*[F.lit(name) for name in REQUESTED_NAMES]), number + 1)


def assigned(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return texts(spark, folder, "source", *columns).withColumn("guardrail", requested_guardrail())


def failed_names() -> Column:
    failing = F.filter("validations", lambda r: r["status"] == "fail")
    return F.concat_ws(",", F.transform(failing, lambda r: r["validator_name"]))


def verdict_rows(verdicts: DataFrame) -> DataFrame:
    """Verdicts as flat columns."""
    return verdicts.select(
        "doc_id", "resolved_guardrail", "valid", "action", failed_names().alias("failed"),
        F.concat_ws(" | ", F.transform("validations", lambda r: r["message"])).alias("messages"),
        "processed_text", F.concat_ws(",", "skipped_validators").alias("skipped"))


# ---- admission ------------------------------------------------------------------------------------

_REASON = """CASE WHEN length(text) < 1 THEN 'empty_text' WHEN length(text) > 50000 THEN 'text_too_long'
    WHEN length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)
                     || chr(8195) || chr(12288))) = 0 THEN 'blank_text'
    WHEN NOT coalesce(ttl, 300) BETWEEN 0 AND 3600 THEN 'ttl_out_of_range' END"""


def _with_ttl(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as requests; the length doubles as the wished TTL, German ones leave it out."""
    return (tables.documents(spark, folder)
            .withColumn("cache_ttl", F.when(F.col("lang") != "de", F.col("n_chars"))))


_TTL_DOCS = "d AS (SELECT *, CASE WHEN lang <> 'de' THEN n_chars END AS ttl FROM documents)"


@query(f"""WITH {_TTL_DOCS} SELECT doc_id, {_REASON} IS NULL AS accepted, {_REASON} AS reject_reason,
           coalesce(ttl, 300) AS effective_ttl FROM d""")
def admission_split(spark, folder):
    out = admission.screened(_with_ttl(spark, folder), ttl="cache_ttl")
    return out.select("doc_id", F.col("reject_reason").isNull().alias("accepted"), "reject_reason",
                      admission.effective_ttl(F.col("cache_ttl")).alias("effective_ttl"))


@query(f"""WITH {_TTL_DOCS} SELECT coalesce({_REASON}, 'accepted') AS reason, count(*) AS n
           FROM d GROUP BY 1""")
def admission_reasons(spark, folder):
    out = admission.screened(_with_ttl(spark, folder), ttl="cache_ttl")
    return (out.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("n")))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, NULL::INT AS ttl FROM documents),
           r AS (SELECT doc_id, {_REASON} AS reason, length(trim(text)) AS n FROM l)
           SELECT doc_id, count(*) AS lines, count(CASE WHEN reason IS NULL THEN 1 END) AS accepted,
                  count(reason) AS rejected, CAST(sum(CASE WHEN reason IS NULL THEN n END) AS BIGINT) AS chars
           FROM r GROUP BY doc_id""")
def admission_lines(spark, folder):
    """Each line of a document as a request of its own; blank lines are turned away."""
    lines = exploded(tables.documents(spark, folder), ["doc_id"], F.split("text", "\n"), "text")
    out = admission.screened(lines)
    return out.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count(F.when(F.col("reject_reason").isNull(), 1)).alias("accepted"),
        F.count("reject_reason").alias("rejected"),
        F.sum(F.when(F.col("reject_reason").isNull(), F.length("text"))).alias("chars"))


@query("""SELECT source AS batch_id, count(*) AS n_texts, count(*) BETWEEN 1 AND 100 AS accepted
          FROM documents GROUP BY source""")
def batch_bounds(spark, folder):
    return admission.batch_sizes(tables.documents(spark, folder).withColumnRenamed("source", "batch_id"))


# ---- validators -----------------------------------------------------------------------------------

@query("""SELECT doc_id, CASE WHEN length(text) > 1000 THEN 'fail' ELSE 'pass' END AS status,
          CASE WHEN length(text) > 1000
               THEN 'Text length (' || length(text) || ') exceeds maximum allowed (1000)'
               ELSE 'Text length is within acceptable limits' END AS message FROM documents""")
def length_check(spark, folder):
    table = engine.measured(tables.documents(spark, folder), ["length_check"])
    out = engine.judged(table, policies.CheckSpec("length_check", max_length=1000))
    return table.select("doc_id", F.when(out.failed, "fail").otherwise("pass").alias("status"),
                        out.message.alias("message"))


@query("""SELECT doc_id, least(CASE WHEN source = 'src0' THEN 20000 ELSE 1000 END, 10000) AS max_length,
          length(text) <= least(CASE WHEN source = 'src0' THEN 20000 ELSE 1000 END, 10000) AS valid
          FROM documents""")
def length_cap(spark, folder):
    """Per-source limits, lowered to the absolute cap."""
    wished = {name: policies.Policy(name, name, (policies.CheckSpec("length_check", limit),))
              for name, limit in (("default", 1000), ("long", 20000))}
    capped = policies.cap_lengths(wished)
    docs = tables.documents(spark, folder).withColumn(
        "guardrail", F.when(F.col("source") == "src0", "long").otherwise("default"))
    limit = F.when(F.col("guardrail") == "long", capped["long"].checks[0].max_length).otherwise(
        capped["default"].checks[0].max_length)
    return (engine.validate_mixed(docs, registry=capped)
            .select("doc_id", limit.alias("max_length"), "valid"))


@query(f"""WITH {sql.measures('documents', 'doc_id')} SELECT doc_id, tox AS score FROM m""")
def toxicity_score(spark, folder):
    score = scorers.LexiconToxicity().score(F.col("text"))
    return computed_once(texts(spark, folder), {"score": score}).select("doc_id", "score")


@query(f"""WITH {sql.measures('documents', 'doc_id')}
           SELECT doc_id, greatest(tox, tox / 2, 0.0) AS score FROM m""")
def toxicity_labels(spark, folder):
    """Reduction of a model's label scores: the best toxic label counts, NON_TOXIC never does."""
    score = F.col("score")
    labels = F.array(*[F.struct(F.lit(name).alias("label"), value.alias("score")) for name, value in (
        ("TOXIC", score), ("severe_toxic", score / 2), ("NON_TOXIC", 1 - score), ("neutral", F.lit(1.0)))])
    return (toxicity_score(spark, folder).withColumn("labels", labels)
            .select("doc_id", scorers.toxicity_of_labels(F.col("labels")).alias("score")))


@query(f"""WITH {sql.measures('documents', 'doc_id')}
           SELECT doc_id, CASE WHEN tox > 0.7 THEN 'fail' ELSE 'pass' END AS status,
                  CASE WHEN tox > 0.7 THEN tox ELSE 1 - tox END AS confidence,
                  CASE WHEN tox > 0.7 THEN 'Toxicity detected (confidence: ' || printf('%.3f', tox) || ')'
                       ELSE 'No toxicity detected' END AS message,
                  'lexicon-toxicity-1' AS model_version FROM m""")
def toxicity_check(spark, folder):
    table = engine.measured(texts(spark, folder), ["toxicity_check"])
    out = engine.judged(table, policies.CheckSpec("toxicity_check", threshold=0.7))
    return table.select("doc_id", F.when(out.failed, "fail").otherwise("pass").alias("status"),
                        out.confidence.alias("confidence"), out.message.alias("message"),
                        F.lit(VALIDATORS["toxicity_check"].version).alias("model_version"))


@query(f"""WITH {sql.measures('documents', 'doc_id')}
           SELECT doc_id, sent AS polarity, CASE WHEN sent < -0.5 THEN 'fail' ELSE 'pass' END AS status,
                  abs(sent) AS confidence FROM m""")
def sentiment_check(spark, folder):
    table = engine.measured(texts(spark, folder), ["sentiment_check"])
    out = engine.judged(table, policies.CheckSpec("sentiment_check", threshold=-0.5))
    return table.select("doc_id", F.col("_sentiment_check__score").alias("polarity"),
                        F.when(out.failed, "fail").otherwise("pass").alias("status"),
                        out.confidence.alias("confidence"))


@query(f"""WITH {sql.measures('documents', 'doc_id')}
           SELECT doc_id, CASE WHEN sent > 0 THEN sent WHEN sent < 0 THEN sent ELSE 0.0 END AS polarity
           FROM m""")
def sentiment_labels(spark, folder):
    """Polarity from a model's label and score."""
    score = scorers.LexiconSentiment().score(F.col("text"))
    labels = F.array(
        F.struct(F.when(F.col("s") > 0, "POSITIVE").when(F.col("s") < 0, "NEGATIVE").otherwise("NEUTRAL")
                 .alias("label"), F.greatest(F.abs("s"), F.lit(0.01)).alias("score")),
        F.struct(F.lit("NEUTRAL").alias("label"), F.lit(0.005).alias("score")))
    return (computed_once(texts(spark, folder), {"s": score}).withColumn("labels", labels)
            .select("doc_id", scorers.polarity_of_labels(F.col("labels")).alias("polarity")))


@query(f"""WITH {sql.measures('documents', 'doc_id')}
           SELECT doc_id, CAST(len(ents) AS INT) AS n_entities,
                  array_to_string({sql.ENTITIES}, ', ') AS entities
           FROM m WHERE len(ents) > 0""")
def pii_entities(spark, folder):
    return (computed_once(texts(spark, folder), {"e": pii.pii_entities(F.col("text"))})
            .where(F.size("e") > 0)
            .select("doc_id", F.size("e").alias("n_entities"), F.concat_ws(", ", "e").alias("entities")))


@query(f"""WITH {sql.measures('documents', 'doc_id')}
           SELECT doc_id, md5(redacted) AS redacted_md5, redacted <> text AS changed FROM m""")
def pii_redact(spark, folder):
    return (texts(spark, folder).withColumn("r", pii.pii_redacted(F.col("text")))
            .select("doc_id", F.md5("r").alias("redacted_md5"), (F.col("r") != F.col("text")).alias("changed")))


@query(f"""WITH {sql.measures('documents', 'doc_id')}, e AS (
             SELECT doc_id, unnest(ents) AS x FROM m)
           SELECT doc_id, x AS entity,
                  CASE WHEN contains(x, '@') THEN '[EMAIL_REDACTED]' ELSE '[PHONE_REDACTED]' END AS tag
           FROM e""")
def pii_friendly_tags(spark, folder):
    """Each entity with the spelled-out tag that replaces it."""
    found = exploded(texts(spark, folder), ["doc_id"], pii.pii_entities(F.col("text")), "e")
    label = F.substring_index("e", ": ", 1)
    return found.select("doc_id", F.substring(F.col("e"), F.length(label) + 3, F.length("e")).alias("entity"),
                        pii.redaction_tag_column(label, friendly=True).alias("tag"))


@query(f"""WITH {sql.measures('documents', 'doc_id')}
           SELECT doc_id, CASE WHEN len(ents) > 0 THEN 'fail' ELSE 'pass' END AS status,
                  CASE WHEN len(ents) > 0 THEN 'PII detected: ' || array_to_string({sql.ENTITIES}, ', ')
                       ELSE 'No PII detected' END AS message,
                  CASE WHEN len(ents) > 0 THEN redacted END AS redacted_text FROM m""")
def pii_verdict(spark, folder):
    table = engine.measured(texts(spark, folder), ["pii_detection"])
    out = engine.judged(table, policies.CheckSpec("pii_detection", on_fail="filter"))
    return table.select("doc_id", F.when(out.failed, "fail").otherwise("pass").alias("status"),
                        out.message.alias("message"), out.redacted.alias("redacted_text"))


@query(f"""WITH {sql.measures('documents', 'doc_id')}, e AS (SELECT unnest(ents) AS x FROM m)
           SELECT CASE WHEN contains(x, '@') THEN 'EMAIL' ELSE 'PHONE' END AS entity_type, count(*) AS n
           FROM e GROUP BY 1""")
def pii_by_type(spark, folder):
    return metrics.pii_by_type(texts(spark, folder).select(pii.pii_entities(F.col("text")).alias("entities")))


def benchmark_names(spark: SparkSession, folder: str) -> DataFrame:
    name = F.regexp_extract("text", r"^(\p{L}+ \p{L}+)", 1)
    return (tables.table(spark, folder, "benchmark").select(name.alias("name")).where("name <> ''")
            .withColumn("label", F.when(F.length("name") % 2 == 0, "PERSON").otherwise("ORG")))


# the first two words of each benchmark text stand for a name, a person's or an organization's by length
_NAMES = r"""
    b AS (SELECT regexp_extract(text, '^(\p{L}+ \p{L}+)', 1) AS name FROM benchmark),
    g AS (SELECT name, CASE WHEN length(name) % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS label
          FROM b WHERE name <> '' GROUP BY name)"""


@query(rf"""WITH {_NAMES},
    hit AS (SELECT d.doc_id, g.name, g.label, strpos(d.text, g.name) AS loc
            FROM documents d JOIN g ON contains(d.text, g.name)
            WHERE regexp_matches(d.text, '(^|[^\p{{L}}])' || g.name || '($|[^\p{{L}}])'))
    SELECT doc_id, string_agg(label || ': ' || name, ', ' ORDER BY loc, label) AS entities,
           count(*) AS n_entities FROM hit GROUP BY doc_id""")
def gazetteer_entities(spark, folder):
    """Known names in documents; the names come from the benchmark texts."""
    found = with_entities(texts(spark, folder), benchmark_names(spark, folder), "doc_id")
    return (found.where(F.size("entities") > 0)
            .select("doc_id", F.concat_ws(", ", "entities").alias("entities"),
                    F.size("entities").cast("long").alias("n_entities")))


@query(rf"""WITH {sql.measures('documents', 'doc_id')}, {_NAMES},
    hit AS (SELECT d.doc_id, count(*) AS k FROM documents d JOIN g ON contains(d.text, g.name)
            WHERE regexp_matches(d.text, '(^|[^\p{{L}}])' || g.name || '($|[^\p{{L}}])') GROUP BY 1)
    SELECT doc_id, coalesce(k, 0) + len(ents) = 0 AS valid, coalesce(k, 0) + len(ents) AS n_entities,
           CASE WHEN coalesce(k, 0) + len(ents) = 0 THEN 'pass' ELSE 'filter' END AS action FROM m LEFT JOIN hit USING (doc_id)""")
def pii_named_verdict(spark, folder):
    """Personal data by pattern and by a table of names, in one check."""
    found = with_names(texts(spark, folder), benchmark_names(spark, folder), "doc_id")
    known = VALIDATORS.with_validator(pii_detection(recognizer=NameColumns("names", "names-1")))
    registry = {"default": policies.Policy("default", "", (policies.CheckSpec("pii_detection", on_fail="filter"),))}
    return engine.validate(found, registry=registry, validators=known).select(
        "doc_id", "valid", "action",
        F.coalesce(F.size(F.col("validations")[0]["entities"]), F.lit(0)).cast("long").alias("n_entities"))


# ---- policies -------------------------------------------------------------------------------------

@query(f"""WITH {sql.POLICIES}, r AS (SELECT {sql.REQUESTED} AS requested FROM documents),
    u AS (SELECT CASE WHEN requested = 'unlisted' THEN 'default' ELSE requested END AS g, count(*) AS n
          FROM r GROUP BY 1)
    SELECT guardrail, CASE guardrail WHEN 'default' THEN 'Default guardrail with basic NLP validation'
             WHEN 'strict' THEN 'Strict content moderation' WHEN 'permissive' THEN 'Permissive content validation'
             WHEN 'batch_optimized' THEN 'Optimized for batch processing'
             WHEN 'content_moderation' THEN 'Comprehensive content moderation'
             WHEN 'customer_service' THEN 'Guardrails for customer service applications' END AS description,
           CAST(2 + CASE WHEN sent_thr IS NULL THEN 0 ELSE 1 END
             + CASE WHEN pii_act IS NULL THEN 0 ELSE 1 END + CASE WHEN skipped = '' THEN 0 ELSE 1 END AS INT)
             AS n_validators,
           concat_ws(',', 'length_check', 'toxicity_check', CASE WHEN sent_thr IS NOT NULL THEN 'sentiment_check' END,
                     CASE WHEN pii_act IS NOT NULL THEN 'pii_detection' END, CASE WHEN skipped <> '' THEN skipped END)
             AS validators,
           concat_ws(',', 'lexicon-toxicity-1', CASE WHEN sent_thr IS NOT NULL THEN 'lexicon-sentiment-1' END,
                     CASE WHEN pii_act IS NOT NULL THEN 'pattern-pii-1' END) AS models,
           300 AS default_ttl, coalesce(n, 0) AS texts
    FROM p LEFT JOIN u ON g = guardrail""")
def policy_listing(spark, folder):
    """All policies, their validators and models, and how many documents resolve to each."""
    used = (tables.documents(spark, folder)
            .groupBy(policies.resolved_guardrail(requested_guardrail()).alias("guardrail"))
            .agg(F.count(F.lit(1)).alias("n")))
    return (policies.policy_summary(spark, policies.REGISTRY, {n: v.version for n, v in VALIDATORS.items() if v.version}).join(used, "guardrail", "left")
            .select("guardrail", "description", "n_validators", "validators", "models",
                    F.lit(policies.DEFAULT_CACHE_TTL).alias("default_ttl"), F.coalesce("n", F.lit(0)).alias("texts")))


@query(f"""SELECT {sql.REQUESTED} AS requested, CASE WHEN {sql.REQUESTED} = 'unlisted' THEN 'default'
           ELSE {sql.REQUESTED} END AS resolved, count(*) AS texts FROM documents GROUP BY 1, 2""")
def policy_fallback(spark, folder):
    requested = requested_guardrail()
    return (tables.documents(spark, folder)
            .groupBy(requested.alias("requested"), policies.resolved_guardrail(requested).alias("resolved"))
            .agg(F.count(F.lit(1)).alias("texts")))


@query(f"""WITH r AS (SELECT {sql.REQUESTED} AS requested FROM documents)
           SELECT requested AS guardrail, 'spam_detection' AS validator, count(*) AS texts FROM r
           WHERE requested = 'strict' GROUP BY 1""")
def policy_skipped(spark, folder):
    """Checks without a validator, with the number of texts that go unchecked by them."""
    checks = policies.policy_rows(spark)
    # both sides are policy tables: a few rows each
    known = spark.createDataFrame([(name,) for name in VALIDATORS], "validator string")
    unknown = checks.join(known, "validator", "left_anti").select("guardrail", "validator")
    used = (tables.documents(spark, folder)
            .groupBy(policies.resolved_guardrail(requested_guardrail()).alias("guardrail"))
            .agg(F.count(F.lit(1)).alias("texts")))
    return unknown.join(used, "guardrail").select("guardrail", "validator", "texts")


@query(f"""WITH {sql.measures('documents', f'doc_id, source, {sql.REQUESTED} AS requested')}, {sql.POLICIES},
    a AS (SELECT m.*, requested IN ('default','strict','permissive','batch_optimized') AS in_first,
                 requested IN ('default','strict','permissive','content_moderation','customer_service') AS in_second
          FROM m),
    v AS (SELECT a.requested, a.doc_id,
            NOT (n > x.max_len OR tox > x.tox_thr OR coalesce(sent < x.sent_thr, false)
                 OR (x.pii_act IS NOT NULL AND len(ents) > 0)) AS first_valid,
            NOT (n > y.max_len OR tox > y.tox_thr OR coalesce(sent < y.sent_thr, false)
                 OR (y.pii_act IS NOT NULL AND len(ents) > 0)) AS second_valid
          FROM a JOIN p x ON x.guardrail = CASE WHEN in_first THEN requested ELSE 'default' END
                 JOIN p y ON y.guardrail = CASE WHEN in_second THEN requested ELSE 'default' END)
    SELECT requested AS guardrail, count(*) AS texts,
           count(CASE WHEN first_valid THEN 1 END) AS valid_first,
           count(CASE WHEN second_valid THEN 1 END) AS valid_second,
           count(CASE WHEN first_valid <> second_valid THEN 1 END) AS differing
    FROM v GROUP BY 1""")
def policy_drift(spark, folder):
    """How the verdicts of the two registries differ on the documents."""
    both = engine.validity_under(
        assigned(spark, folder), {"first_valid": policies.SERVICE, "second_valid": policies.CONFIG})
    return both.groupBy("guardrail").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count(F.when(F.col("first_valid"), 1)).alias("valid_first"),
        F.count(F.when(F.col("second_valid"), 1)).alias("valid_second"),
        F.count(F.when(F.col("first_valid") != F.col("second_valid"), 1)).alias("differing"))


_SIDES = """
    a(guardrail, validator, max_length, threshold, on_fail) AS (VALUES
      ('default', 'length_check', 1000, NULL::DOUBLE, 'exception'), ('default', 'toxicity_check', NULL, 0.7, 'exception'),
      ('default', 'sentiment_check', NULL, -0.5, 'log'), ('strict', 'length_check', 500, NULL, 'exception'),
      ('strict', 'toxicity_check', NULL, 0.3, 'exception'), ('strict', 'sentiment_check', NULL, -0.3, 'exception'),
      ('strict', 'pii_detection', NULL, NULL, 'filter'), ('strict', 'spam_detection', NULL, 0.8, 'exception'),
      ('permissive', 'length_check', 2000, NULL, 'log'), ('permissive', 'toxicity_check', NULL, 0.9, 'log'),
      ('batch_optimized', 'length_check', 1000, NULL, 'exception'), ('batch_optimized', 'toxicity_check', NULL, 0.7, 'exception')),
    b AS (SELECT * FROM a WHERE guardrail NOT IN ('batch_optimized') AND validator <> 'spam_detection' UNION ALL VALUES
      ('content_moderation', 'length_check', 1500, NULL, 'exception'), ('content_moderation', 'toxicity_check', NULL, 0.5, 'exception'),
      ('content_moderation', 'sentiment_check', NULL, -0.4, 'log'), ('content_moderation', 'pii_detection', NULL, NULL, 'filter'),
      ('customer_service', 'length_check', 3000, NULL, 'exception'), ('customer_service', 'toxicity_check', NULL, 0.6, 'log'),
      ('customer_service', 'sentiment_check', NULL, -0.6, 'log'), ('customer_service', 'pii_detection', NULL, NULL, 'filter'))"""
_USED = f"u AS (SELECT {sql.REQUESTED} AS guardrail, count(*) AS texts FROM documents GROUP BY 1)"


def _asking(spark, folder) -> DataFrame:
    """Texts per requested policy: a row for each name that is asked for."""
    return tables.documents(spark, folder).groupBy(requested_guardrail().alias("guardrail")).agg(
        F.count(F.lit(1)).alias("texts"))


@query(f"""WITH {_SIDES}, {_USED},
    m AS (SELECT *, 'first' AS winner FROM a UNION ALL
          SELECT *, 'second' FROM b WHERE guardrail NOT IN (SELECT guardrail FROM a))
    SELECT m.*, coalesce(texts, 0) AS texts FROM m LEFT JOIN u USING (guardrail)""")
def registry_merge(spark, folder):
    """The checks of both registries, the first one's policies first, with the number of texts that ask for each."""
    merged = policies.registry_merge(policies.policy_rows(spark, policies.SERVICE), policies.policy_rows(spark, policies.CONFIG))
    return merged.drop("pos").join(_asking(spark, folder), "guardrail", "left").fillna(0, ["texts"])


@query(f"""WITH {_SIDES}, {_USED},
    d AS (SELECT guardrail, validator, CASE WHEN b.validator IS NULL THEN 'first only' WHEN a.validator IS NULL THEN 'second only' END
                 AS drift FROM a FULL JOIN b USING (guardrail, validator))
    SELECT guardrail, validator, CASE WHEN guardrail IN (SELECT guardrail FROM a) THEN 'first' ELSE 'second' END AS winner, drift,
           coalesce(texts, 0) AS texts FROM d LEFT JOIN u USING (guardrail) WHERE drift IS NOT NULL""")
def registry_drift(spark, folder):
    """How the two registries' checks differ, with the number of texts that ask for each policy."""
    drift = policies.registry_differences(policies.policy_rows(spark, policies.SERVICE), policies.policy_rows(spark, policies.CONFIG))
    return drift.join(_asking(spark, folder), "guardrail", "left").fillna(0, ["texts"])


def _pages_sql() -> str:
    names = ", ".join(f"'{name}': '{char}'" for name, char in markup.ENTITIES.items()).replace("'\''", "chr(39)")
    return f"""
    WITH h1 AS (SELECT page_id, regexp_replace(regexp_replace(html, '{markup.HIDDEN}', ' ', 'g'),
                                               '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS x FROM pages),
    h2 AS (SELECT page_id, regexp_replace(regexp_replace(x, '{markup.BLOCKS}', chr(10), 'g'), '{markup.TAGS}', '', 'g') AS x
           FROM h1),
    h3 AS (SELECT page_id, string_split(trim(regexp_replace(regexp_replace(x, ' +', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'),
                                             ' ' || chr(10)), '&') AS parts FROM h2),
    h4 AS (SELECT page_id, unnest(range(len(parts))) AS i, unnest(parts) AS part FROM h3),
    h5 AS (SELECT *, regexp_extract(part, '{markup.REFERENCE}', 1) AS name FROM h4),
    h6 AS (SELECT *, CASE WHEN name ILIKE '#x%' THEN ('0x' || name[3:])::INT WHEN name LIKE '#%' THEN name[2:]::INT END AS code
           FROM h5),
    h7 AS (SELECT *, CASE WHEN code IS NULL THEN MAP {{{names}}}[name]
                          WHEN code > 0 AND code < 1114112 AND code NOT BETWEEN 55296 AND 57343 THEN chr(code) END AS char FROM h6),
    page_text AS (SELECT page_id, string_agg(CASE WHEN i = 0 THEN part
                      ELSE coalesce(char || part[length(name) + 2:], '&' || part) END, '' ORDER BY i) AS text
                  FROM h7 GROUP BY page_id)"""


@query(f"""{_pages_sql()}, {sql.measures('page_text', 'page_id')}, {sql.POLICIES},
    j AS (SELECT * FROM m JOIN p ON guardrail = 'customer_service'), {sql.FLAGS}
    SELECT page_id, md5(text) AS text_md5, n AS length, {sql.VALID} AS valid, {sql.ACTION} AS action, {sql.FAILED} AS failed,
           md5({sql.PROCESSED}) AS processed_md5 FROM f""")
def pages_validate(spark, folder):
    """Web pages as texts: markup to text, then the verdicts of the customer policy."""
    verdicts = engine.validate(tables.page_texts(spark, folder), "customer_service")
    return verdicts.select(
        "page_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("length"), "valid", "action",
        failed_names().alias("failed"), F.md5("processed_text").alias("processed_md5"))


def _validate_query(name: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return verdict_rows(engine.validate(texts(spark, folder), name))

    run.__name__ = f"validate_{name}"
    query(f"{sql.by_policy(name)} SELECT {sql.VERDICT} FROM f")(run)


for _name in policies.REGISTRY:
    _validate_query(_name)


@query(f"{sql.by_source()} SELECT {sql.VERDICT} FROM f")
def validate_mixed(spark, folder):
    """Every document under the policy its source asks for."""
    return verdict_rows(engine.validate_mixed(assigned(spark, folder)))


@query(f"""WITH {sql.measures('documents', 'doc_id, source')},
    q(g, max_len, thr) AS (SELECT DISTINCT source, 400 + 100 * (CAST(substr(source, 4) AS INT) % 10),
                                  0.4 + 0.05 * (CAST(substr(source, 4) AS INT) % 5)
                           FROM documents WHERE CAST(substr(source, 4) AS INT) % 3 <> 0)
    SELECT doc_id, CASE WHEN g IS NULL THEN 'default' ELSE g END AS resolved_guardrail,
           CASE WHEN g IS NULL THEN NOT (n > 1000 OR tox > 0.7)
                ELSE NOT (n > max_len OR tox > thr) END AS valid,
           CASE WHEN g IS NULL THEN '' ELSE 'spam_detection' END AS skipped
    FROM m LEFT JOIN q ON g = source""")
def validate_policy_table(spark, folder):
    """Policies in a table, one per source, with the default for sources that have none."""
    number = F.substring("source", 4, 9).try_cast("int")
    own = (tables.documents(spark, folder).select("source").distinct().where(number % 3 != 0))

    def checks(validator: str, pos: int, limit: Column, threshold: Column) -> DataFrame:
        return own.select(F.col("source").alias("guardrail"), F.lit(pos).alias("pos"),
                          F.lit(validator).alias("validator"), limit.cast("int").alias("max_length"),
                          threshold.cast("double").alias("threshold"), F.lit("exception").alias("on_fail"))

    none = F.lit(None)
    default = policies.policy_rows(spark, {"default": policies.REGISTRY["batch_optimized"]}).withColumn(
        "guardrail", F.lit("default"))
    table = (checks("length_check", 0, 400 + 100 * (number % 10), none)
             .unionByName(checks("toxicity_check", 1, none, 0.4 + 0.05 * (number % 5)))
             .unionByName(checks("spam_detection", 2, none, F.lit(0.8)))
             .unionByName(default))
    verdicts = engine.validate_with_table(texts(spark, folder, "source"), table, "doc_id", "source")
    return verdicts.select("doc_id", "resolved_guardrail", "valid",
                           F.concat_ws(",", "skipped_validators").alias("skipped"))


@query(f"""{sql.by_source()}, r AS (
    SELECT doc_id, guardrail AS resolved_guardrail, 0 AS pos, 'length_check' AS validator_name, fl AS failed,
           {sql.LENGTH_MESSAGE} AS message, NULL::DOUBLE AS confidence, len_act AS on_fail_action FROM f
    UNION ALL SELECT doc_id, guardrail, 1, 'toxicity_check', ft, {sql.TOXICITY_MESSAGE},
           CASE WHEN ft THEN tox ELSE 1 - tox END, tox_act FROM f
    UNION ALL SELECT doc_id, guardrail, 2, 'sentiment_check', fs, {sql.SENTIMENT_MESSAGE}, abs(sent), sent_act
           FROM f WHERE sent_thr IS NOT NULL
    UNION ALL SELECT doc_id, guardrail, 3, 'pii_detection', fp, {sql.PII_MESSAGE}, NULL, pii_act
           FROM f WHERE pii_act IS NOT NULL)
    SELECT doc_id, resolved_guardrail, pos, validator_name, CASE WHEN failed THEN 'fail' ELSE 'pass' END AS status,
           message, confidence, on_fail_action FROM r""")
def validator_results(spark, folder):
    """One row per document and check."""
    rows = engine.validator_results(engine.validate_mixed(assigned(spark, folder)), "doc_id")
    return rows.select("doc_id", "resolved_guardrail", "pos", "validator_name", "status", "message",
                       "confidence", "on_fail_action")


@query(f"""{sql.by_source()} SELECT guardrail AS resolved_guardrail,
           sum(2 + (sent_thr IS NOT NULL)::INT + (pii_act IS NOT NULL)::INT)::BIGINT AS checked, 0::BIGINT AS broken
           FROM f GROUP BY 1""")
def result_contract(spark, folder):
    """Check results by policy, and how many of them break their contract."""
    rows = engine.validator_results(engine.validate_mixed(assigned(spark, folder)), "doc_id")
    return rows.groupBy("resolved_guardrail").agg(
        F.count(F.lit(1)).alias("checked"),
        F.count(F.when(~admission.sound_result(), 1)).alias("broken"))


@query("""SELECT DISTINCT v.name AS validator, v.version AS model_version, d.n AS texts
          FROM (VALUES ('toxicity_check', 'lexicon-toxicity-1'), ('sentiment_check', 'lexicon-sentiment-1'),
                       ('pii_detection', 'pattern-pii-1')) v(name, version),
               (SELECT count(*) AS n FROM documents) d""")
def model_info(spark, folder):
    """Scorer versions behind the verdicts of the documents."""
    return (tables.documents(spark, folder).agg(F.count(F.lit(1)).alias("texts"))
            .select(F.explode(engine.model_info()).alias("validator", "model_version"), "texts"))


@query(f"""WITH {sql.measures('documents', 'doc_id')}, {sql.POLICIES},
           v AS (SELECT guardrail, NOT (n > max_len OR tox > tox_thr OR coalesce(sent < sent_thr, false)
                        OR (pii_act IS NOT NULL AND len(ents) > 0)) AS valid FROM m, p)
           SELECT guardrail, count(*) AS texts, count(CASE WHEN valid THEN 1 END) AS valid_texts,
                  round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM v GROUP BY 1""")
def policy_comparison(spark, folder):
    """The same documents under every policy."""
    return (engine.compare_policies(texts(spark, folder), list(policies.REGISTRY))
            .withColumn("pass_rate", F.round("pass_rate", 6)))


@query(f"""{sql.by_source()}, r AS (
    SELECT guardrail, 'length_check' AS v, fl AS failed FROM f UNION ALL SELECT guardrail, 'toxicity_check', ft FROM f
    UNION ALL SELECT guardrail, 'sentiment_check', fs FROM f WHERE sent_thr IS NOT NULL
    UNION ALL SELECT guardrail, 'pii_detection', fp FROM f WHERE pii_act IS NOT NULL)
    SELECT coalesce(guardrail, '*') AS resolved_guardrail, coalesce(v, '*') AS validator_name,
           CAST(grouping(guardrail, v) AS BIGINT) AS level, count(*) AS checks,
           count(CASE WHEN failed THEN 1 END) AS failures
    FROM r GROUP BY ROLLUP (guardrail, v)""")
def policy_rollup(spark, folder):
    rows = engine.validator_results(engine.validate_mixed(assigned(spark, folder)), "doc_id")
    return (metrics.policy_rollup(rows)
            .withColumns({c: F.coalesce(c, F.lit("*")) for c in ("resolved_guardrail", "validator_name")}))


@query(f"""{sql.by_source()} SELECT guardrail AS resolved_guardrail, {sql.ACTION} AS action, count(*) AS texts,
           count({sql.PROCESSED}) AS rewritten FROM f GROUP BY 1, 2""")
def on_fail_routing(spark, folder):
    return (engine.validate_mixed(assigned(spark, folder)).groupBy("resolved_guardrail", "action")
            .agg(F.count(F.lit(1)).alias("texts"), F.count("processed_text").alias("rewritten")))


@query(f"""WITH {sql.measures('documents', 'doc_id')}
           SELECT doc_id, n >= 10 AS scored, CASE WHEN n < 10 THEN false ELSE NOT tox > 0.7 END AS valid FROM m""")
def precheck_then_score(spark, folder):
    """Short texts are turned away unscored; the two parts come back together."""
    docs = texts(spark, folder)
    long_enough = engine.worth_scoring(F.col("text"))
    table = engine.measured(docs.where(long_enough), ["toxicity_check"])
    out = engine.judged(table, policies.CheckSpec("toxicity_check", threshold=0.7))
    return (table.select("doc_id", F.lit(True).alias("scored"), (~out.failed).alias("valid"))
            .unionByName(docs.where(~long_enough).select(
                "doc_id", F.lit(False).alias("scored"), F.lit(False).alias("valid"))))


@query(f"""WITH {sql.measures('documents', 'doc_id, source, lang')}, {sql.POLICIES},
           j AS (SELECT * FROM m JOIN p ON p.guardrail = 'strict'), {sql.FLAGS}
           SELECT doc_id, CASE WHEN lang = 'es' THEN 'failure' ELSE 'success' END AS status,
                  CASE WHEN lang = 'es' THEN 'Internal error during validation: unsupported language es'
                       ELSE 'Validation completed successfully' END AS message,
                  CASE WHEN lang = 'es' THEN false ELSE {sql.VALID} END AS valid,
                  CAST(CASE WHEN lang = 'es' THEN 0 ELSE 4 END AS INT) AS n_results FROM f""")
def failure_response(spark, folder):
    """Texts on which the engine failed get a failure response without results."""
    docs = texts(spark, folder, "lang").withColumn(
        "engine_error", F.when(F.col("lang") == "es", F.lit("unsupported language es")))
    return (engine.validate(docs, "strict", engine_error="engine_error")
            .select("doc_id", "status", "message", "valid", F.size("validations").alias("n_results")))


@query(f"""WITH {sql.measures('documents', 'doc_id, lang')}
           SELECT doc_id, NOT (n > 500 OR (lang = 'fr' OR tox > 0.3)) AS valid,
                  CASE WHEN lang = 'fr' THEN 'Toxicity validation error: no model for fr'
                       WHEN tox > 0.3 THEN 'Toxicity detected (confidence: ' || printf('%.3f', tox) || ')'
                       ELSE 'No toxicity detected' END AS message,
                  CASE WHEN lang = 'fr' THEN NULL WHEN tox > 0.3 THEN tox ELSE 1 - tox END AS confidence
           FROM m""")
def scorer_error(spark, folder):
    """A scorer error fails the check closed: error as message, no confidence."""
    docs = texts(spark, folder, "lang").withColumns({
        "s": scorers.LexiconToxicity().score(F.col("text")),
        "e": F.when(F.col("lang") == "fr", F.lit("no model for fr"))})
    registry = {"default": policies.Policy("default", "length and toxicity", (
        policies.CheckSpec("length_check", 500), policies.CheckSpec("toxicity_check", None, 0.3)))}
    known = VALIDATORS.with_validator(toxicity_validator(scorers.ScoreColumns("s", "given-1", "e")))
    check = F.col("validations")[1]
    return (engine.validate(docs, registry=registry, validators=known)
            .select("doc_id", "valid", check["message"].alias("message"), check["confidence"].alias("confidence")))


def repetition_check() -> Validator:
    """A validator of the user's own: too many lines of a text are repeats."""
    def measure(text: Column) -> Measures:
        lines = F.split(text, "\n")
        return {"share": 1 - F.size(F.array_distinct(lines)) / F.size(lines)}

    def judge(measures: Measures, params: Params) -> Outcome:
        failed = measures["share"] > F.coalesce(params.threshold, F.lit(0.5))
        return Outcome(failed, F.when(failed, F.lit("Repeated lines")).otherwise(F.lit("Lines differ")),
                       measures["share"])

    return Validator("repetition_check", measure, judge, "repetition-1")


@query("""WITH l AS (SELECT doc_id, length(text) AS n, string_split(text, chr(10)) AS x FROM documents),
          s AS (SELECT doc_id, n, 1 - CAST(len(list_distinct(x)) AS DOUBLE) / len(x) AS share FROM l)
          SELECT doc_id, NOT (n > 3000 OR share > 0.2) AS valid, round(share, 6) AS confidence,
                 CASE WHEN share > 0.2 THEN 'Repeated lines' ELSE 'Lines differ' END AS message FROM s""")
def custom_validator(spark, folder):
    """A custom validator registered by name and used by a policy."""
    registry = {"default": policies.Policy("default", "custom", (
        policies.CheckSpec("length_check", 3000), policies.CheckSpec("repetition_check", None, 0.2)))}
    known = VALIDATORS.with_validator(repetition_check())
    check = F.col("validations")[1]
    return (engine.validate(texts(spark, folder), registry=registry, validators=known)
            .select("doc_id", "valid", F.round(check["confidence"], 6).alias("confidence"),
                    check["message"].alias("message")))


@query(f"""WITH {sql.measures('documents', 'doc_id')},
    a AS (SELECT *, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20
                         THEN 'canary' ELSE 'stable' END AS arm FROM m)
    SELECT arm, count(*) AS texts,
           count(CASE WHEN NOT tox > CASE WHEN arm = 'canary' THEN 0.3 ELSE 0.7 END THEN 1 END) AS valid_texts
    FROM a GROUP BY 1""")
def canary_split(spark, folder):
    """A fifth of the documents is judged by a stricter threshold; pass counts per arm."""
    table = engine.measured(texts(spark, folder), ["toxicity_check"])
    canary = engine.judged(table, policies.CheckSpec("toxicity_check", threshold=0.3))
    stable = engine.judged(table, policies.CheckSpec("toxicity_check", threshold=0.7))
    split = table.withColumn("arm", arm(F.col("doc_id"), 20))
    valid = F.when(F.col("arm") == "canary", ~canary.failed).otherwise(~stable.failed)
    return split.groupBy("arm").agg(F.count(F.lit(1)).alias("texts"),
                                    F.count(F.when(valid, 1)).alias("valid_texts"))


# ---- reports --------------------------------------------------------------------------------------

@query(f"""{sql.by_source()}, r AS (
    SELECT guardrail, 'length_check' AS v, fl AS failed FROM f UNION ALL SELECT guardrail, 'toxicity_check', ft FROM f
    UNION ALL SELECT guardrail, 'sentiment_check', fs FROM f WHERE sent_thr IS NOT NULL
    UNION ALL SELECT guardrail, 'pii_detection', fp FROM f WHERE pii_act IS NOT NULL)
    SELECT v AS validator_name, CASE WHEN failed THEN 'fail' ELSE 'pass' END AS status,
           guardrail AS resolved_guardrail, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def validation_counter(spark, folder):
    rows = engine.validator_results(engine.validate_mixed(assigned(spark, folder)), "doc_id")
    return metrics.counter(rows, "validator_name", "status", "resolved_guardrail")


@query(f"""{sql.by_source()} SELECT guardrail AS resolved_guardrail,
           CASE WHEN {sql.VALID} THEN 'valid' ELSE 'invalid' END AS result, count(*) AS n FROM f GROUP BY 1, 2""")
def texts_processed(spark, folder):
    return metrics.texts_processed(engine.validate_mixed(assigned(spark, folder)))


@query(f"""WITH {sql.measures('documents', 'doc_id')}
           SELECT CASE WHEN tox < 0.5 THEN 'low' WHEN tox < 0.8 THEN 'medium' ELSE 'high' END AS confidence_level,
                  count(*) AS n FROM m WHERE tox > 0 GROUP BY 1""")
def toxicity_levels(spark, folder):
    return metrics.toxicity_levels(toxicity_score(spark, folder))


@query(f"""WITH {sql.measures('documents', 'doc_id')}, {sql.POLICIES},
    v AS (SELECT doc_id, count(CASE WHEN n > max_len OR tox > tox_thr OR coalesce(sent < sent_thr, false)
                 OR (pii_act IS NOT NULL AND len(ents) > 0) THEN 1 END) AS failing_policies, any_value(tox) AS score
          FROM m, p GROUP BY doc_id)
    SELECT doc_id, failing_policies, score FROM v ORDER BY failing_policies DESC, score DESC, doc_id LIMIT 20""")
def top_failing_texts(spark, folder):
    """Report of the twenty texts that fail most policies."""
    checks = [(p, c) for p in policies.REGISTRY.values() for c in p.checks if c.validator in VALIDATORS]
    table = engine.measured(texts(spark, folder), [c.validator for _, c in checks])
    failing = F.lit(0)
    for policy in policies.REGISTRY.values():
        failed = F.lit(False)
        for owner, check in checks:
            if owner is policy:
                failed = failed | engine.judged(table, check).failed
        failing = failing + failed.cast("int")
    return (table.select("doc_id", failing.cast("long").alias("failing_policies"),
                         F.col("_toxicity_check__score").alias("score"))
            .orderBy(F.desc("failing_policies"), F.desc("score"), "doc_id").limit(20))
