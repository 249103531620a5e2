"""Safety classification: prompt, default scorer, verdict parsing and violation categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.text import stripped

# ---- Fixed values ---------------------------------------------------------------------------------
MAX_PROMPT_TOKENS = 2048
SAFE_CONFIDENCE = 0.95
UNSAFE_CONFIDENCE = 0.9
UNCLEAR_CONFIDENCE = 0.5
ERROR_CONFIDENCE = 0.0
UNCLEAR_MESSAGE = "Content classification unclear"
UNSPECIFIED_MESSAGE = "Content violates safety guidelines"
CATEGORIES = {
    "violence": ["violence", "violent", "harm"],
    "hate_speech": ["hate", "discrimination", "racist"],
    "harassment": ["harassment", "bullying"],
    "self_harm": ["self-harm", "suicide"],
    "sexual": ["sexual", "explicit"],
    "illegal": ["illegal", "criminal"],
}
# ---- End of fixed values --------------------------------------------------------------------------

KEYWORDS = tuple(word for words in CATEGORIES.values() for word in words)


def prompt(text: Column, context: Column) -> Column:
    """The classifier's input: the text, headed by the context when there is one."""
    headed = F.concat(F.lit("Context: "), context, F.lit("\n\nText: "), text)
    return F.when(F.coalesce(context, F.lit("")) != "", headed).otherwise(text)


def truncated_prompt(prompt_text: Column, max_tokens: int = MAX_PROMPT_TOKENS) -> Column:
    """The part of a prompt a model plug-in of limited input reads. The default scorer reads it all."""
    return F.array_join(F.slice(F.split(prompt_text, " "), 1, max_tokens), " ")


def keyword_verdict(prompt_text: Column) -> Column:
    """Default scorer: ``safe``, or ``unsafe`` and the keywords found on the next line."""
    lowered = F.lower(prompt_text)
    found = F.concat_ws(",", *[F.when(lowered.contains(word), F.lit(word)) for word in KEYWORDS])
    return F.when(found == "", F.lit("safe")).otherwise(F.concat(F.lit("unsafe\n"), found))


def _normal(raw: Column) -> Column:
    return F.lower(stripped(F.coalesce(raw, F.lit(""))))


def says_unsafe(raw: Column) -> Column:
    return _normal(raw).contains("unsafe")


def says_safe(raw: Column) -> Column:
    return _normal(raw).contains("safe") & ~says_unsafe(raw)


def confidence(raw: Column) -> Column:
    return (F.when(says_safe(raw), F.lit(SAFE_CONFIDENCE))
            .when(says_unsafe(raw), F.lit(UNSAFE_CONFIDENCE))
            .otherwise(F.lit(UNCLEAR_CONFIDENCE)))


def safety_level(is_safe: Column) -> Column:
    return F.when(is_safe, F.lit("safe")).otherwise(F.lit("unsafe"))


def category_messages(raw: Column) -> Column:
    """Violations named in a verdict, in category order, joined by ``;``. Substrings count."""
    verdict = _normal(raw)
    named = []
    for category, keywords in CATEGORIES.items():
        present = verdict.contains(keywords[0])
        for keyword in keywords[1:]:
            present = present | verdict.contains(keyword)
        named.append(F.when(present, F.lit(f"Detected {category} content")))
    joined = F.concat_ws(";", *named)
    return F.when(joined == "", F.lit(UNSPECIFIED_MESSAGE)).otherwise(joined)


def violations(raw: Column) -> Column:
    """Violation messages as an array; empty for a safe verdict."""
    return (F.when(says_safe(raw), F.array().cast("array<string>"))
            .when(says_unsafe(raw), F.split(category_messages(raw), ";"))
            .otherwise(F.array(F.lit(UNCLEAR_MESSAGE))))


def parsed(raw: Column, error: Column | None = None) -> Column:
    """A verdict as one struct; a scorer error is unsafe, with the error as its violation."""
    def result(is_safe: Column, sure: Column, found: Column) -> Column:
        return F.struct(is_safe.alias("is_safe"), safety_level(is_safe).alias("safety_level"),
                        sure.alias("confidence"), found.alias("violations"))

    verdict = result(says_safe(raw), confidence(raw), violations(raw))
    if error is None:
        return verdict
    failed = result(F.lit(False), F.lit(ERROR_CONFIDENCE),
                    F.array(F.concat(F.lit("Validation error: "), error)))
    return F.when(error.isNotNull(), failed).otherwise(verdict)
