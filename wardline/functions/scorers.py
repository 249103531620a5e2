"""Default scorers, and the reduction of a model's label scores to one number.

A scorer turns a text column into a score column. The defaults are word lists: they need no model
download, run in generated JVM code and give the same number on every engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.text import vocabulary_hits, words

TOXIC_WORDS = (
    "idiot", "stupid", "moron", "loser", "trash", "scum", "clown", "worthless", "pathetic",
    "disgusting",
)
POSITIVE_WORDS = (
    "good", "great", "best", "nice", "love", "happy", "wonderful", "excellent", "amazing", "thank",
    "thanks", "appreciate", "hope", "help",
)
NEGATIVE_WORDS = (
    "bad", "terrible", "hate", "awful", "worst", "sad", "angry", "horrible", "disappointed", "ugly",
    "pathetic", "disgusting", "worthless", "trash",
)


LEXICON = tuple(dict.fromkeys(TOXIC_WORDS + POSITIVE_WORDS + NEGATIVE_WORDS))


def hits(text: Column, vocabulary: tuple[str, ...]) -> Column:
    """How many different words of the vocabulary the text holds.

    The default scorers share one reduction of the text to the words any of them knows; within a
    projection Spark evaluates the shared part once.
    """
    known = words(text)
    if set(vocabulary) <= set(LEXICON):
        known = vocabulary_hits(known, LEXICON)
    return F.size(vocabulary_hits(known, vocabulary))


@dataclass(frozen=True)
class LexiconToxicity:
    """1 - 0.5^n for n different toxic words: 0, 0.5, 0.75, ... exact in binary."""

    vocabulary: tuple[str, ...] = TOXIC_WORDS
    version: str = "lexicon-toxicity-1"

    def score(self, text: Column) -> Column:
        return F.lit(1.0) - F.pow(F.lit(0.5), hits(text, self.vocabulary))

    def error(self, text: Column) -> Column | None:
        return None


@dataclass(frozen=True)
class LexiconSentiment:
    """(positive - negative) / (positive + negative) different words, 0 without any."""

    positive: tuple[str, ...] = POSITIVE_WORDS
    negative: tuple[str, ...] = NEGATIVE_WORDS
    version: str = "lexicon-sentiment-1"

    def score(self, text: Column) -> Column:
        pos, neg = hits(text, self.positive), hits(text, self.negative)
        return F.when(pos + neg > 0, F.round((pos - neg) / (pos + neg), 6)).otherwise(F.lit(0.0))

    def error(self, text: Column) -> Column | None:
        return None


@dataclass(frozen=True)
class ScoreColumns:
    """A scorer whose result is already in the table, such as the output of a model plug-in.

    ``error_column`` holds a message for texts the model failed on: those fail closed.
    """

    score_column: str
    version: str
    error_column: str | None = None

    def score(self, text: Column) -> Column:
        return F.col(self.score_column)

    def error(self, text: Column) -> Column | None:
        return F.col(self.error_column) if self.error_column else None


def toxicity_of_labels(labels: Column) -> Column:
    """Highest score of the labels that say toxic; 0 without one. NON_TOXIC does not count."""
    toxic = F.filter(labels, lambda x: F.upper(x["label"]).contains("TOXIC")
                     & ~F.upper(x["label"]).startswith("NON"))
    return F.coalesce(F.array_max(F.transform(toxic, lambda x: x["score"])), F.lit(0.0))


def polarity(label: Column, score: Column) -> Column:
    """Signed sentiment: positive scores up, negative scores down, anything else 0."""
    return (F.when(F.upper(label) == "POSITIVE", score)
            .when(F.upper(label) == "NEGATIVE", -score)
            .otherwise(F.lit(0.0)))


def polarity_of_labels(labels: Column) -> Column:
    """Polarity of the best-scored label; 0 without labels."""
    best = F.array_max(F.transform(
        labels, lambda x: F.struct(x["score"].alias("score"), x["label"].alias("label"))))
    return F.coalesce(polarity(best["label"], best["score"]), F.lit(0.0))
