"""Shared parts of the checking SQL, written by hand and not derived from the library's code."""

from __future__ import annotations

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9]{0,2} ?\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}"

TOXIC = ("['idiot','stupid','moron','loser','trash','scum','clown','worthless','pathetic',"
         "'disgusting']")
POSITIVE = ("['good','great','best','nice','love','happy','wonderful','excellent','amazing','thank',"
            "'thanks','appreciate','hope','help']")
NEGATIVE = ("['bad','terrible','hate','awful','worst','sad','angry','horrible','disappointed','ugly',"
            "'pathetic','disgusting','worthless','trash']")


def measures(table: str, columns: str, text: str = "text") -> str:
    """CTE ``m``: the columns of a table with length, scores, entities and redaction of its text."""
    return f"""
    t AS (SELECT {columns}, {text} AS text,
                 regexp_split_to_array(lower({text}), '[^\\p{{L}}]+') AS tok FROM {table}),
    c AS (SELECT *, len(list_intersect(tok, {POSITIVE})) AS pos,
                 len(list_intersect(tok, {NEGATIVE})) AS neg FROM t),
    m AS (SELECT *, length(text) AS n,
                 1 - pow(0.5, len(list_intersect(tok, {TOXIC}))) AS tox,
                 CASE WHEN pos + neg > 0
                      THEN round(CAST(CAST(pos AS BIGINT) - CAST(neg AS BIGINT) AS DOUBLE) / (pos + neg), 6)
                      ELSE 0.0 END AS sent,
                 regexp_extract_all(text, '{EMAIL}|{PHONE}') AS ents,
                 regexp_replace(regexp_replace(text, '{EMAIL}', '[EMAIL_REDACTED]', 'g'),
                                '{PHONE}', '[PHONE_REDACTED]', 'g') AS redacted
          FROM c)"""


# the merged registry, one row per policy; the first registry wins where both define a name
POLICIES = """
    p(guardrail, max_len, len_act, tox_thr, tox_act, sent_thr, sent_act, pii_act, skipped) AS (VALUES
      ('default', 1000, 'exception', 0.7::DOUBLE, 'exception', -0.5::DOUBLE, 'log', NULL, ''),
      ('strict', 500, 'exception', 0.3, 'exception', -0.3, 'exception', 'filter', 'spam_detection'),
      ('permissive', 2000, 'log', 0.9, 'log', NULL, NULL, NULL, ''),
      ('batch_optimized', 1000, 'exception', 0.7, 'exception', NULL, NULL, NULL, ''),
      ('content_moderation', 1500, 'exception', 0.5, 'exception', -0.4, 'log', 'filter', ''),
      ('customer_service', 3000, 'exception', 0.6, 'log', -0.6, 'log', 'filter', ''))"""

# needs m joined with p as j
FLAGS = """
    f AS (SELECT *, n > max_len AS fl, tox > tox_thr AS ft, coalesce(sent < sent_thr, false) AS fs,
                 pii_act IS NOT NULL AND len(ents) > 0 AS fp FROM j)"""

# ``valid``, ``action`` and ``processed_text`` of f
VALID = "NOT (fl OR ft OR fs OR fp)"
ACTION = ("CASE WHEN (fl AND len_act = 'exception') OR (ft AND tox_act = 'exception') "
          "OR (fs AND coalesce(sent_act, '') = 'exception') THEN 'block' "
          "WHEN fp AND pii_act = 'filter' THEN 'filter' ELSE 'pass' END")
PROCESSED = "CASE WHEN fp AND redacted <> text THEN redacted END"
ENTITIES = "[CASE WHEN contains(x, '@') THEN 'EMAIL: ' ELSE 'PHONE: ' END || x FOR x IN ents]"
FAILED = ("concat_ws(',', CASE WHEN fl THEN 'length_check' END, CASE WHEN ft THEN 'toxicity_check' END, "
          "CASE WHEN fs THEN 'sentiment_check' END, CASE WHEN fp THEN 'pii_detection' END)")

LENGTH_MESSAGE = ("CASE WHEN fl THEN 'Text length (' || n || ') exceeds maximum allowed (' || max_len || ')' "
                  "ELSE 'Text length is within acceptable limits' END")
TOXICITY_MESSAGE = ("CASE WHEN ft THEN 'Toxicity detected (confidence: ' || printf('%.3f', tox) || ')' "
                    "ELSE 'No toxicity detected' END")
SENTIMENT_MESSAGE = ("CASE WHEN fs THEN 'Negative sentiment detected (score: ' || printf('%.3f', sent) || ')' "
                     "ELSE 'Sentiment is acceptable' END")
PII_MESSAGE = (f"CASE WHEN fp THEN 'PII detected: ' || array_to_string({ENTITIES}, ', ') "
               "ELSE 'No PII detected' END")
MESSAGES = (f"concat_ws(' | ', {LENGTH_MESSAGE}, {TOXICITY_MESSAGE}, "
            f"CASE WHEN sent_thr IS NOT NULL THEN {SENTIMENT_MESSAGE} END, "
            f"CASE WHEN pii_act IS NOT NULL THEN {PII_MESSAGE} END)")

# which policy a document asks for; the last name is in no registry
REQUESTED = ("(['default','strict','permissive','content_moderation','customer_service',"
             "'batch_optimized','unlisted'])[(CAST(substr(source, 4) AS INT) % 7) + 1]")


def by_policy(guardrail: str) -> str:
    """CTEs up to ``f`` for all documents under one policy."""
    return (f"WITH {measures('documents', 'doc_id, source, lang')}, {POLICIES}, "
            f"j AS (SELECT * FROM m JOIN p ON p.guardrail = '{guardrail}'), {FLAGS}")


def by_source() -> str:
    """CTEs up to ``f`` for all documents, each under the policy its source asks for."""
    return (f"WITH {measures('documents', f'doc_id, source, lang, {REQUESTED} AS requested')}, {POLICIES}, "
            "j AS (SELECT * FROM m JOIN p ON p.guardrail = CASE WHEN m.requested = 'unlisted' "
            f"THEN 'default' ELSE m.requested END), {FLAGS}")


VERDICT = (f"doc_id, guardrail AS resolved_guardrail, {VALID} AS valid, {ACTION} AS action, "
           f"{FAILED} AS failed, {MESSAGES} AS messages, {PROCESSED} AS processed_text, skipped")
