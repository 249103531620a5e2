"""Validators: what they measure on a text, and how a policy's parameters judge the measurement.

The two halves are kept apart on purpose. Measuring is the costly part (tokenizing, patterns) and
depends on the text alone, so the engine does it once per text in one projection, however many
policies are applied. Judging compares the measured columns with parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import pii
from wardline.functions.scorers import LexiconSentiment, LexiconToxicity
from wardline.functions.text import fixed3
from wardline.plans.policies import (
    DEFAULT_MAX_LENGTH, DEFAULT_SENTIMENT_THRESHOLD, DEFAULT_TOXICITY_THRESHOLD,
)


@dataclass(frozen=True)
class Params:
    """The text, and the parameters of one check; NULL where the policy leaves them out."""

    text: Column
    max_length: Column
    threshold: Column


@dataclass(frozen=True)
class Outcome:
    """What a validator says about one text."""

    failed: Column
    message: Column
    confidence: Column | None = None
    entities: Column | None = None
    redacted: Column | None = None


Measures = dict[str, Column]


@dataclass(frozen=True)
class Validator:
    """``measure(text)`` gives named columns, ``judge(measures, params)`` the outcome."""

    name: str
    measure: Callable[[Column], Measures]
    judge: Callable[[Measures, Params], Outcome]
    version: str | None = None


def length_check() -> Validator:
    def judge(measures: Measures, params: Params) -> Outcome:
        length = measures["length"]
        limit = F.coalesce(params.max_length, F.lit(DEFAULT_MAX_LENGTH))
        failed = length > limit
        too_long = F.concat(F.lit("Text length ("), length.cast("string"),
                            F.lit(") exceeds maximum allowed ("), limit.cast("string"), F.lit(")"))
        return Outcome(failed, F.when(failed, too_long)
                       .otherwise(F.lit("Text length is within acceptable limits")))

    return Validator("length_check", lambda text: {"length": F.length(text)}, judge)


def _score_measures(scorer) -> Callable[[Column], Measures]:
    def measure(text: Column) -> Measures:
        error = scorer.error(text)
        return {"score": scorer.score(text)} | ({} if error is None else {"error": error})
    return measure


def _fail_closed(measures: Measures, subject: str, outcome: Outcome) -> Outcome:
    """A text the scorer could not score fails, with the error as message and no confidence."""
    error = measures.get("error")
    if error is None:
        return outcome
    return Outcome(
        F.when(error.isNotNull(), F.lit(True)).otherwise(outcome.failed),
        F.when(error.isNotNull(), F.concat(F.lit(f"{subject} validation error: "), error))
        .otherwise(outcome.message),
        None if outcome.confidence is None else F.when(error.isNull(), outcome.confidence),
    )


def toxicity_check(scorer=LexiconToxicity()) -> Validator:
    def judge(measures: Measures, params: Params) -> Outcome:
        score = measures["score"]
        failed = score > F.coalesce(params.threshold, F.lit(DEFAULT_TOXICITY_THRESHOLD))
        detected = F.concat(F.lit("Toxicity detected (confidence: "), fixed3(score), F.lit(")"))
        return _fail_closed(measures, "Toxicity", Outcome(
            failed, F.when(failed, detected).otherwise(F.lit("No toxicity detected")),
            F.when(failed, score).otherwise(F.lit(1.0) - score)))

    return Validator("toxicity_check", _score_measures(scorer), judge, scorer.version)


def sentiment_check(scorer=LexiconSentiment()) -> Validator:
    def judge(measures: Measures, params: Params) -> Outcome:
        score = measures["score"]
        failed = score < F.coalesce(params.threshold, F.lit(DEFAULT_SENTIMENT_THRESHOLD))
        negative = F.concat(F.lit("Negative sentiment detected (score: "), fixed3(score), F.lit(")"))
        return _fail_closed(measures, "Sentiment", Outcome(
            failed, F.when(failed, negative).otherwise(F.lit("Sentiment is acceptable")),
            F.abs(score)))

    return Validator("sentiment_check", _score_measures(scorer), judge, scorer.version)


@dataclass(frozen=True)
class NameColumns:
    """Persons, organizations and places that another step found, from a name table or a model.

    ``names`` is a column of ``pii.NAMES``; ``error_column`` says why a text could not be read.
    """

    names: str
    version: str
    error_column: str | None = None


def pii_detection(friendly: bool = False, version: str = "pattern-pii-1",
                  recognizer: NameColumns | None = None) -> Validator:
    """Personal data by pattern and, with a recognizer, by name; an error of the recognizer fails the text."""
    def measure(text: Column) -> Measures:
        patterns = pii.pii_entities(text)
        if recognizer is None:
            return {"entities": patterns}
        names = F.col(recognizer.names)
        error = F.col(recognizer.error_column) if recognizer.error_column else F.lit(None).cast("string")
        return {"entities": pii.with_names(text, patterns, names), "names": names, "error": error}

    def judge(measures: Measures, params: Params) -> Outcome:
        entities = measures["entities"]
        failed = F.size(entities) > 0
        found = F.concat(F.lit("PII detected: "), F.concat_ws(", ", entities))
        redacted = pii.pii_redacted(params.text, friendly, failed)
        if "names" in measures:
            redacted = pii.names_redacted(redacted, measures["names"], friendly)
        outcome = Outcome(failed, F.when(failed, found).otherwise(F.lit("No PII detected")),
                          entities=F.when(failed, entities), redacted=F.when(failed, redacted))
        closed = _fail_closed(measures, "PII", outcome)
        return replace(closed, confidence=None, entities=outcome.entities, redacted=outcome.redacted)

    return Validator("pii_detection", measure, judge, recognizer.version if recognizer else version)


class ValidatorSet(dict[str, Validator]):
    """The validators a session knows, by the name policies use."""

    def with_validator(self, validator: Validator) -> ValidatorSet:
        """A copy that also holds, or replaces, ``validator``."""
        return ValidatorSet(self | {validator.name: validator})


VALIDATORS = ValidatorSet({v.name: v for v in (
    length_check(), toxicity_check(), sentiment_check(), pii_detection())})
