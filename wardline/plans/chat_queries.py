"""Queries on safety classification and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import safety
from wardline.functions.arrays import exploded
from wardline.operators import conversation, engine, metrics
from wardline.plans import sql
from wardline.plans.catalog import query
from wardline.plans.text_queries import texts
from wardline.sources import tables

_WORDS = ("'violence', 'violent', 'harm', 'hate', 'discrimination', 'racist', 'harassment', 'bullying', "
          "'self-harm', 'suicide', 'sexual', 'explicit', 'illegal', 'criminal'")


def _prompt(text: str, context: str) -> str:
    return f"CASE WHEN coalesce({context}, '') <> '' THEN 'Context: ' || {context} || chr(10) || chr(10) || 'Text: ' || {text} ELSE {text} END"


def _raw(prompt: str) -> str:
    hits = ", ".join(f"CASE WHEN contains(lower({prompt}), {word}) THEN {word} END" for word in _WORDS.split(", "))
    return (f"CASE WHEN concat_ws(',', {hits}) = '' THEN 'safe' "
            f"ELSE 'unsafe' || chr(10) || concat_ws(',', {hits}) END")


_CATEGORY_SQL = """CASE WHEN raw = 'safe' THEN '' ELSE concat_ws(';',
    CASE WHEN contains(raw, 'violence') OR contains(raw, 'violent') OR contains(raw, 'harm')
         THEN 'Detected violence content' END,
    CASE WHEN contains(raw, 'hate') OR contains(raw, 'discrimination') OR contains(raw, 'racist')
         THEN 'Detected hate_speech content' END,
    CASE WHEN contains(raw, 'harassment') OR contains(raw, 'bullying') THEN 'Detected harassment content' END,
    CASE WHEN contains(raw, 'self-harm') OR contains(raw, 'suicide') THEN 'Detected self_harm content' END,
    CASE WHEN contains(raw, 'sexual') OR contains(raw, 'explicit') THEN 'Detected sexual content' END,
    CASE WHEN contains(raw, 'illegal') OR contains(raw, 'criminal') THEN 'Detected illegal content' END) END"""

# documents of English sources have a context, the others an empty or no context
_CONTEXT = "CASE WHEN lang = 'en' THEN source WHEN lang = 'fr' THEN '' END"
_DOCS = f"""d AS (SELECT doc_id, text, {_CONTEXT} AS context FROM documents),
    q AS (SELECT doc_id, {_prompt('text', 'context')} AS prompt FROM d),
    r AS (SELECT doc_id, prompt, {_raw('prompt')} AS raw FROM q)"""


def _prompts(spark, folder) -> DataFrame:
    context = F.when(F.col("lang") == "en", F.col("source")).when(F.col("lang") == "fr", "")
    return texts(spark, folder, "lang", "source").select(
        "doc_id", safety.prompt(F.col("text"), context).alias("prompt"))


def _verdicts(spark, folder) -> DataFrame:
    return _prompts(spark, folder).select("doc_id", safety.keyword_verdict(F.col("prompt")).alias("raw"))


@query(f"""WITH {_DOCS} SELECT doc_id, CAST(length(prompt) AS INT) AS prompt_length, md5(prompt) AS prompt_md5,
           CAST(length(array_to_string((string_split(prompt, ' '))[1:2048], ' ')) AS INT) AS model_input_length
           FROM r""")
def safety_prompt(spark, folder):
    """Prompts, their length, and the length a model limited to 2048 tokens would read."""
    return _prompts(spark, folder).select(
        "doc_id", F.length("prompt").alias("prompt_length"), F.md5("prompt").alias("prompt_md5"),
        F.length(safety.truncated_prompt(F.col("prompt"))).alias("model_input_length"))


@query(f"""WITH {_DOCS} SELECT doc_id, raw = 'safe' AS is_safe, CASE WHEN raw = 'safe' THEN 'safe' ELSE 'unsafe' END
           AS safety_level, CASE WHEN raw = 'safe' THEN 0.95::DOUBLE ELSE 0.9 END AS confidence,
           {_CATEGORY_SQL} AS violations FROM r""")
def safety_verdict(spark, folder):
    v = safety.parsed(F.col("raw"))
    return _verdicts(spark, folder).withColumn("v", v).select(
        "doc_id", "v.is_safe", "v.safety_level", "v.confidence",
        F.concat_ws(";", "v.violations").alias("violations"))


@query(f"""WITH {_DOCS}, u AS (SELECT doc_id, string_split({_CATEGORY_SQL}, ';') AS v FROM r WHERE raw <> 'safe')
           SELECT violation, count(*) AS n FROM (SELECT unnest(v) AS violation FROM u) GROUP BY 1""")
def safety_categories(spark, folder):
    """Documents by violation."""
    found = exploded(_verdicts(spark, folder), [], safety.violations(F.col("raw")), "violation")
    return metrics.counter(found, "violation")


# what a model could answer, by document: each form of verdict occurs
_ANSWERS = ["safe", "  SAFE \n", "unsafe", "unsafe: violence", "Unsafe self-harm", "", "maybe"]
_ANSWER_SQL = ("CASE doc_id % 8 WHEN 0 THEN 'safe' WHEN 1 THEN '  SAFE ' || chr(10) WHEN 2 THEN 'unsafe' "
               "WHEN 3 THEN 'unsafe: violence' WHEN 4 THEN 'Unsafe self-harm' WHEN 5 THEN '' WHEN 6 THEN 'maybe' "
               "END")


@query(f"""WITH a AS (SELECT doc_id, lower(trim(coalesce({_ANSWER_SQL}, ''), ' ' || chr(10))) AS raw,
                             doc_id % 16 = 7 AS broken FROM documents),
    c AS (SELECT *, contains(raw, 'unsafe') AS u, contains(raw, 'safe') AND NOT contains(raw, 'unsafe') AS s FROM a)
    SELECT doc_id, NOT broken AND s AS is_safe,
           CASE WHEN broken THEN 0.0::DOUBLE WHEN s THEN 0.95 WHEN u THEN 0.9 ELSE 0.5 END AS confidence,
           CASE WHEN broken THEN 'Validation error: out of memory' WHEN s THEN ''
                WHEN u THEN CASE WHEN {_CATEGORY_SQL} = '' THEN 'Content violates safety guidelines'
                                 ELSE {_CATEGORY_SQL} END
                ELSE 'Content classification unclear' END AS violations FROM c""")
def safety_answers(spark, folder):
    """Parsing of every form of model answer, errors included; anything unclear is unsafe."""
    kind = F.col("doc_id") % 8
    raw = F.lit(None).cast("string")
    for i, answer in enumerate(_ANSWERS):
        raw = F.when(kind == i, F.lit(answer)).otherwise(raw)
    error = F.when(F.col("doc_id") % 16 == 7, F.lit("out of memory"))
    v = safety.parsed(F.col("raw"), F.col("error"))
    return (tables.documents(spark, folder).select("doc_id", raw.alias("raw"), error.alias("error"))
            .withColumn("v", v)
            .select("doc_id", "v.is_safe", "v.confidence", F.concat_ws(";", "v.violations").alias("violations")))


# ---- conversations --------------------------------------------------------------------------------

_LEAD = """n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, lead(turn) OVER w AS next_turn
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(f"""WITH {_LEAD} SELECT conv_id, turn, next_turn AS reply_turn, text AS user_text, next_text AS reply_text
           FROM n WHERE role = 'user' AND next_role = 'assistant'""")
def turn_pairs(spark, folder):
    return conversation.turn_pairs(tables.conversations(spark, folder))


_TURN_SAFETY = f"""WITH {_LEAD}, s AS (SELECT conv_id, turn,
      {_raw("('Context: user_input' || chr(10) || chr(10) || 'Text: ' || text)")} = 'safe' AS user_input_safe,
      {_raw("('Context: ai_output' || chr(10) || chr(10) || 'Text: ' || next_text)")} = 'safe' AS ai_output_safe
    FROM n WHERE role = 'user' AND next_role = 'assistant')"""


@query(f"""{_TURN_SAFETY} SELECT *, user_input_safe AND ai_output_safe AS conversation_safe FROM s""")
def turn_safety(spark, folder):
    return conversation.turn_safety(tables.conversations(spark, folder)).drop("reply_turn")


@query(f"""{_TURN_SAFETY}, f AS (SELECT conv_id, turn, CASE WHEN turn % 5 <> 3 THEN user_input_safe END AS is_safe FROM s)
           SELECT conv_id, turn FROM f WHERE coalesce(is_safe, false)""")
def only_safe(spark, folder):
    """Turns known to be safe, when some verdicts are missing."""
    flagged = conversation.turn_safety(tables.conversations(spark, folder)).select(
        "conv_id", "turn", F.when(F.col("turn") % 5 != 3, F.col("user_input_safe")).alias("is_safe"))
    return conversation.only_safe(flagged).select("conv_id", "turn")


_CHAT = f"""WITH {sql.measures('conversations', 'conv_id, turn, role')}, {sql.POLICIES},
    j AS (SELECT * FROM m JOIN p ON p.guardrail = 'strict'), {sql.FLAGS},
    v AS (SELECT *, {sql.VALID} AS valid, {sql.ACTION} AS action, {sql.PROCESSED} AS processed FROM f)"""


@query(f"""{_CHAT} SELECT conv_id, turn, role, valid, action = 'block' AS blocked,
           md5(coalesce(processed, text)) AS gated_md5 FROM v WHERE role <> 'system'""")
def gates(spark, folder):
    """Input and output gate of every user text and reply."""
    turns = tables.conversations(spark, folder).where(F.col("role") != "system")
    gated = conversation.gate(engine.validate(turns, "strict"))
    return gated.select("conv_id", "turn", "role", "valid", "blocked", F.md5("gated_text").alias("gated_md5"))


_OUTCOMES = f"""{_CHAT}, o AS (
    SELECT u.conv_id, u.turn, CASE WHEN u.action = 'block' THEN 'blocked_input' WHEN a.turn IS NULL THEN 'unanswered'
                WHEN a.action = 'block' THEN 'blocked_output' ELSE 'delivered' END AS outcome,
           coalesce(a.processed, a.text) AS reply
    FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM v) u
    LEFT JOIN v a ON a.conv_id = u.conv_id AND a.turn = u.next_turn AND a.role = 'assistant'
    WHERE u.role = 'user')"""


@query(f"""{_OUTCOMES} SELECT conv_id, turn, outcome, CASE outcome
           WHEN 'blocked_input' THEN 'Your message contains content that violates our guidelines.'
           WHEN 'blocked_output' THEN 'I apologize, but I cannot provide a response that meets our content guidelines. Please try rephrasing your question.'
           WHEN 'delivered' THEN reply END AS response FROM o""")
def turn_outcome(spark, folder):
    return conversation.turn_outcomes(tables.conversations(spark, folder), "strict").select(
        "conv_id", "turn", "outcome", "response")


@query(f"""{_OUTCOMES} SELECT conv_id, count(*) AS user_turns,
           count(CASE WHEN outcome = 'blocked_input' THEN 1 END) AS blocked_inputs,
           count(CASE WHEN outcome = 'blocked_output' THEN 1 END) AS blocked_outputs,
           count(CASE WHEN outcome = 'delivered' THEN 1 END) AS delivered,
           bool_and(outcome NOT IN ('blocked_input', 'blocked_output')) AS clean FROM o GROUP BY conv_id""")
def conversation_rollup(spark, folder):
    return conversation.conversation_rollup(
        conversation.turn_outcomes(tables.conversations(spark, folder), "strict"))


@query(f"""{_CHAT} SELECT role, guardrail AS resolved_guardrail, count(*) AS texts,
           round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM v GROUP BY 1, 2""")
def role_pass_rate(spark, folder):
    verdicts = engine.validate(tables.conversations(spark, folder), "strict")
    return verdicts.groupBy("role", "resolved_guardrail").agg(
        F.count(F.lit(1)).alias("texts"),
        F.round(F.avg(F.when(F.col("valid"), 1.0).otherwise(0.0)), 6).alias("pass_rate"))


@query(f"""{_CHAT} SELECT conv_id, turn, turn % 4 = 2 OR action = 'block' AS blocked_closed,
           turn % 4 <> 2 AND action = 'block' AS blocked_open FROM v WHERE role = 'user'""")
def service_failure(spark, folder):
    """The input gate when the service fails on some turns: closed by default, open on request."""
    users = tables.conversations(spark, folder).where(F.col("role") == "user").withColumn(
        "engine_error", F.when(F.col("turn") % 4 == 2, F.lit("service unreachable")))
    verdicts = engine.validate(users, "strict", engine_error="engine_error")
    closed = conversation.gate(verdicts).withColumnRenamed("blocked", "blocked_closed")
    return conversation.gate(closed, fail_open=True).select(
        "conv_id", "turn", "blocked_closed", F.col("blocked").alias("blocked_open"))


@query("""SELECT conv_id, turn, concat_ws(';', CASE WHEN turn % 3 <> 0 THEN 'session_id=s' || turn END,
          CASE WHEN conv_id % 2 = 0 THEN 'user_id=u' || conv_id END) AS context FROM conversations""")
def request_context(spark, folder):
    """Context of a chat request: ids that are missing or empty are left out."""
    from wardline.operators.tracing import flat_tags

    user = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("u"), F.col("conv_id")))
    session = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("s"), F.col("turn"))).otherwise("")
    return tables.conversations(spark, folder).select(
        "conv_id", "turn", flat_tags(conversation.request_context(user, session)).alias("context"))


@query("""SELECT conv_id, max(turn) - min(turn) + 1 - count(*) AS missing FROM conversations GROUP BY conv_id
          HAVING max(turn) - min(turn) + 1 <> count(*)""")
def turn_gaps(spark, folder):
    """Conversations with missing turns."""
    return conversation.missing_turns(tables.conversations(spark, folder))


@query("""SELECT conv_id, max(turn) - min(turn) + 1 - count(*) AS missing FROM conversations GROUP BY conv_id""")
def turn_gap_counts(spark, folder):
    """Missing turns of every conversation of the whole table, none included."""
    return conversation.gap_counts(tables.conversations(spark, folder))


@query("""WITH n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, lead(turn) OVER w AS next_turn
                    FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, next_turn AS reply_turn, md5(text) AS user_md5, md5(next_text) AS reply_md5
    FROM n WHERE role = 'user' AND next_role = 'assistant'""")
def turn_pairs_with_holes(spark, folder):
    """Pairs of turns where what the system says in between leaves holes in the numbers."""
    spoken = tables.conversations(spark, folder).where(F.col("role") != "system")
    return conversation.turn_pairs(spoken).select(
        "conv_id", "turn", "reply_turn", F.md5("user_text").alias("user_md5"), F.md5("reply_text").alias("reply_md5"))
