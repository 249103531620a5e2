"""Model plug-ins: any Python model as a scorer, and a classifier trained on labelled texts.

A plug-in is loaded once per Python worker and fed Arrow batches. It is a function that takes a list
of texts and gives, for each, a list of ``(label, score)`` or a string. A text on which it raises gets
the error instead, and validators fail that text closed; the rest of the batch is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predict = Callable[[list[str]], list]

_loaded: dict[tuple[str, str], Predict] = {}


class ModelRegistry(dict[tuple[str, str], Callable[[], Predict]]):
    """Load functions by engine and model name, from which a job picks its model by name."""

    def register(self, engine: str, model: str, load: Callable[[], Predict]) -> None:
        self[engine, model] = load

    def names(self) -> list[str]:
        return [f"{engine}/{model}" for engine, model in self]

    def scores(self, text: Column, engine: str, model: str, version: str = "") -> Column:
        return model_scores(text, f"{engine}/{model}", self[engine, model], version)

    def verdicts(self, prompt: Column, engine: str, model: str, version: str = "") -> Column:
        return model_verdicts(prompt, f"{engine}/{model}", self[engine, model], version)


def loaded(name: str, load: Callable[[], Predict], version: str = "") -> Predict:
    """The model of this worker process, loaded on first use of its name and version."""
    if (name, version) not in _loaded:
        _loaded[name, version] = load()
    return _loaded[name, version]


def predict_batch(predict: Predict, texts: list[str]) -> list[tuple[object, str | None]]:
    """``(prediction, error)`` per text. A failing batch is halved until the failing texts stand alone."""
    try:
        predictions = list(predict(texts))
        if len(predictions) != len(texts):
            raise ValueError(f"the model gave {len(predictions)} results for {len(texts)} texts")
        return [(prediction, None) for prediction in predictions]
    except Exception as error:
        if len(texts) <= 1:
            return [(None, str(error)) for _ in texts]
        half = len(texts) // 2
        return predict_batch(predict, texts[:half]) + predict_batch(predict, texts[half:])


def model_scores(text: Column, name: str, load: Callable[[], Predict], version: str = "") -> Column:
    """``struct<labels: array<struct<label, score>>, error: string>`` from a labelling model."""
    @F.pandas_udf("labels array<struct<label:string,score:double>>, error string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = loaded(name, load, version)
        for texts in batches:
            rows = predict_batch(predict, texts.tolist())
            yield pd.DataFrame({
                "labels": [None if e else [{"label": l, "score": float(s)} for l, s in p] for p, e in rows],
                "error": [e for _, e in rows]})
    return score(text)


def model_verdicts(prompt: Column, name: str, load: Callable[[], Predict], version: str = "") -> Column:
    """``struct<raw: string, error: string>`` from a safety model that answers in words."""
    @F.pandas_udf("raw string, error string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = loaded(name, load, version)
        for prompts in batches:
            rows = predict_batch(predict, prompts.tolist())
            yield pd.DataFrame({"raw": [p for p, _ in rows], "error": [e for _, e in rows]})
    return answer(prompt)


def model_names(text: Column, name: str, load: Callable[[], Predict], version: str = "") -> Column:
    """``struct<names: array<struct<label, name>>, error: string>`` from a model that lists (label, name)."""
    @F.pandas_udf("names array<struct<label:string,name:string>>, error string")
    def recognize(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = loaded(name, load, version)
        for texts in batches:
            rows = predict_batch(predict, texts.tolist())
            yield pd.DataFrame({
                "names": [None if e else [{"label": l, "name": n} for l, n in p] for p, e in rows],
                "error": [e for _, e in rows]})
    return recognize(text)


def train_toxicity(texts: DataFrame, label: str = "toxic", text: str = "text", features: int = 1 << 16):
    """A logistic regression on hashed words, fitted by Spark on labelled texts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"\P{L}+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_features", numFeatures=features, binary=True),
        LogisticRegression(featuresCol="_features", labelCol=label, regParam=0.01, maxIter=20,
                           probabilityCol="_probability", predictionCol="_prediction",
                           rawPredictionCol="_raw"),
    ]
    return Pipeline(stages=stages).fit(texts.withColumn(label, F.col(label).cast("double")))


def trained_scores(model, texts: DataFrame, score: str = "score") -> DataFrame:
    """The texts with the probability of being toxic."""
    from pyspark.ml.functions import vector_to_array

    return (model.transform(texts)
            .withColumn(score, vector_to_array("_probability")[1])
            .drop("_tokens", "_features", "_probability", "_prediction", "_raw"))


def ranking_quality(scored: DataFrame, label: str, score: str = "score") -> float:
    """Share of pairs of a positive and a negative row in which the positive scores higher (area under the curve)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rows = scored.select(score, F.col(label).cast("double").alias(label))
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label).evaluate(rows)
