"""Quality classifier: expectation-maximisation over heuristic labellers, and a hashed linear scorer.

Seven rules vote on every document. Expectation-maximisation over the counts of vote patterns estimates how
each rule votes on good and on bad documents; the posterior labels of a bounded sample train a logistic
scorer on hashed word shapes, which decides about every document.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import Scratch, mixed, over_batches, split_words

LABELLERS = ("symbols", "capitals", "exclaimed", "bare marks", "repeats", "plain words", "variety")

# share from which a labeller says bad, share up to which it says good; the last two fall with quality
BOUNDS = ((.20, .05), (.50, .10), (.20, .05), (.15, .05), (.20, .05), (-.60, -.90), (-.20, -.50))
BAD_ODDS, GOOD_ODDS = -3.0, 1.0  # log-odds a vote for bad has at least, a vote for good at most

LEAST_WORDS = 20        # "variety" says nothing of shorter texts

SAMPLE_ROWS = 8_192     # documents, taken by hash, on which the scorer is trained
BUCKETS = 1_024         # hashed features
KEEP_FROM = 0.5         # probability of good quality from which a document stays

SYMBOLS = re.compile(r"[#$%&*^~<>{}\[\]\\|=@]")
EXCLAIMED = re.compile(r"[!?]{2}")
PLAIN = re.compile(r"[.,;:!?'\"()-]?\w+(?:[.,;:'\"()/-]\w+)*[.,;:!?'\"()-]?")


def _letters(word: str) -> str | None:
    """Shape of a plain word in lower case, in capitals or with one capital; None for another word."""
    if word.islower():
        return "aa"[:len(word)]
    if word.isupper():
        return "AA"[:len(word)]
    return "Aaa"[:len(word)] if word[0].isupper() and word[1:].islower() else None


def known_of(word: str) -> tuple[tuple[bool, ...], str]:
    """What the first labellers look for in a word, and its shape; most words need no pattern."""
    core, mark = (word, "") if word.isalpha() else (word[:-1], word[-1])
    if core.isalpha() and mark in ",.;:":
        shape = _letters(core)
        if shape:
            return (False, len(word) > 1 and word.isupper(), False, False, True), shape + mark
    return ((SYMBOLS.search(word) is not None, len(word) > 1 and word.isupper(), EXCLAIMED.search(word) is not None,
             not any(map(str.isalnum, word)), PLAIN.fullmatch(word) is not None), _shape(word))


def _shape(word: str) -> str:
    """Letters as a or A, digits as 0, other characters as they are; runs shortened to two."""
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    return "".join(c for i, c in enumerate(kinds) if i < 2 or not c == kinds[i - 1] == kinds[i - 2])


class Words:
    """The words of a batch of texts, with what is known of each distinct word looked up once."""

    def __init__(self, texts: pa.Array):
        values, self.starts = split_words(texts, lower=False)
        coded = values.dictionary_encode()
        known = coded.dictionary.to_pylist()
        self.code = np.asarray(coded.indices).astype(np.int64) if len(values) else np.zeros(0, np.int64)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.starts))
        marks = np.zeros((5, len(known)), bool)
        shapes = np.zeros(len(known), np.uint64)
        hashes: dict[str, int] = {}
        for i, (found, shape) in enumerate(map(known_of, known)):
            marks[:, i] = found
            if shape not in hashes:
                hashes[shape] = xxhash.xxh64_intdigest(shape)
            shapes[i] = hashes[shape]
        self.marks, self.shape = marks[:, self.code], shapes[self.code]
        self.same = np.zeros((2, len(self.code)), bool)  # equal to the word before, to the one before that
        for back in (1, 2):
            self.same[back - 1, back:] = ((self.code[back:] == self.code[:-back])
                                          & (self.text[back:] == self.text[:-back]))

    def mean(self, values: np.ndarray) -> np.ndarray:
        """Mean over each text's words, zero without words."""
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return (total[self.starts[1:]] - total[self.starts[:-1]]) / np.maximum(np.diff(self.starts), 1)

    def votes(self) -> np.ndarray:
        """One row per text, one column per labeller: 1 good, -1 bad, 0 no vote."""
        count = np.diff(self.starts)
        different = np.zeros(len(count))
        if len(self.code):
            pairs = np.unique(self.text * (self.code.max() + 1) + self.code)
            different = np.bincount(pairs // (self.code.max() + 1), minlength=len(count))
        shares = [*(self.mean(m) for m in self.marks[:4]), self.mean(self.same.any(axis=0)),
                  -self.mean(self.marks[4]), -different / np.maximum(count, 1)]
        votes = np.stack([np.where(s > bad, -1, np.where(s <= good, 1, 0))
                          for s, (bad, good) in zip(shares, BOUNDS)], axis=1)
        votes[count < LEAST_WORDS, -1] = 0
        votes[count == 0] = 0
        return votes.astype(np.int8)

    def features(self) -> tuple[np.ndarray, ...]:
        """Bucket of each word for its shape, for its shape after the one before, and for repeats."""
        before = np.concatenate([[np.uint64(0)], self.shape[:-1]])[:len(self.shape)]
        before[self.starts[:-1][np.diff(self.starts) > 0]] = np.uint64(0)
        repeat = (1 + self.same[0] + 2 * self.same[1]).astype(np.uint64)
        return tuple((mixed(v) % np.uint64(BUCKETS)).astype(np.int64)
                     for v in (self.shape, mixed(before) + self.shape, repeat))

    def vectors(self) -> np.ndarray:
        """Share of each bucket among a text's words."""
        out = np.zeros((len(self.starts) - 1, BUCKETS), np.float32)
        for bucket in self.features():
            np.add.at(out, (self.text, bucket), 1)
        return out / np.maximum(np.diff(self.starts), 1)[:, None]

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Probability of good quality of each text."""
        margin = self.mean(sum(weights[bucket] for bucket in self.features())) + bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, bad_odds: float = BAD_ODDS,
               good_odds: float = GOOD_ODDS) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over distinct vote patterns: log-odds of good, base and per labeller and vote.

    The table says how often each labeller gives each vote on bad and on good documents. It starts from the
    belief that one vote for bad makes a document bad, and counts are smoothed. Each rule knows one kind of
    badness, so what it does not object to says little: a vote for good weighs ``good_odds`` at most, and a vote
    for bad at least ``bad_odds``, or labellers of a frequent kind would outvote those of a rare one.
    """
    good = np.where((patterns < 0).any(axis=1), .1, .9)
    for _ in range(rounds):
        share = np.clip((counts * good).sum() / max(counts.sum(), 1), .02, .98)
        table = np.zeros((patterns.shape[1], 3, 2))
        for vote in (-1, 0, 1):
            cast = (patterns == vote) * counts[:, None]
            table[:, vote + 1, 1] = (cast * good[:, None]).sum(axis=0) + .5
            table[:, vote + 1, 0] = (cast * (1 - good)[:, None]).sum(axis=0) + .5
        table /= table.sum(axis=1, keepdims=True)
        odds = np.log(table[:, :, 1] / table[:, :, 0])
        odds[:, 0] = np.minimum(odds[:, 0], bad_odds)
        odds[:, 1:] = np.clip(odds[:, 1:], -good_odds, good_odds)
        base = math.log(share / (1 - share))
        margin = base + sum(odds[j, patterns[:, j] + 1] for j in range(patterns.shape[1]))
        good = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return base, odds


def posterior(votes: np.ndarray, base: float, odds: np.ndarray) -> np.ndarray:
    """Probability of good quality given the votes; without a vote for bad it is at least one half."""
    margin = base + sum(odds[j, votes[:, j] + 1] for j in range(votes.shape[1]))
    good = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return np.where((votes < 0).any(axis=1), good, np.maximum(good, .5))


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> dict:
    """Labellers' log-odds from the votes of all documents, and the scorer's weights from a sample.

    The vote patterns that reach the driver are at most 3 to the number of labellers. The sample is drawn by a hash
    of id and text, so that the copies of one text are sampled as rarely as other rows: ``sample_rows`` on average.
    Sampled rows of one part of a batch with the same text are one vector with their number as its weight, so rows
    that repeat both, however many, add few vectors.
    """
    spark, total = docs.sparkSession, docs.count()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = max(1, math.ceil(total / sample_rows))
    named = [F.col(id_col).cast("string")] if id_col in docs.columns else []
    sampled = F.pmod(F.xxhash64(F.lit(11), text, *named), F.lit(every)) == 0
    rows = docs.select(F.lit(0).alias("n"), text.alias("text"), sampled.alias("sampled"))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        votes = Words(batch.column(1)).votes()
        chosen = batch.column(2).to_numpy(zero_copy_only=False)
        vectors, copies = [None] * batch.num_rows, [0] * batch.num_rows
        first: dict[str, int] = {}
        for i, own in zip(np.flatnonzero(chosen), batch.column(1).filter(pa.array(chosen)).to_pylist()):
            copies[first.setdefault(own, int(i))] += 1
        if first:
            at = list(first.values())
            for i, vector in zip(at, Words(batch.column(1).take(pa.array(at))).vectors()):
                vectors[i] = vector.tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(votes.tolist(), pa.list_(pa.int8())), pa.array(vectors, pa.list_(pa.float32())),
             pa.array(copies, pa.int32())], names=["votes", "vector", "copies"])

    seen = Scratch(spark, "quality").keep(
        over_batches(rows, scan, "votes array<tinyint>, vector array<float>, copies int"))
    found = seen.groupBy("votes").count().collect()
    patterns = np.array([r["votes"] for r in found], np.int64).reshape(-1, len(LABELLERS))
    base, odds = accuracies(patterns, np.array([r["count"] for r in found], np.float64))
    weights, bias = np.zeros(BUCKETS), base
    labels = {tuple(p): float(g) for p, g in zip(patterns.tolist(), posterior(patterns, base, odds))}
    if len({round(g) for g in labels.values()}) > 1:
        good = F.create_map(*[F.lit(x) for p, g in labels.items() for x in (",".join(map(str, p)), g)])[
            F.array_join(F.transform("votes", lambda v: v.cast("string")), ",")]
        soft = seen.where("vector is not null").select(
            array_to_vector(F.col("vector")).alias("features"), good.alias("g"), "copies")
        both = soft.select("features", F.explode(F.array(
            F.struct(F.lit(1.0).alias("label"), (F.col("g") * F.col("copies")).alias("weight")),
            F.struct(F.lit(0.0).alias("label"), ((1 - F.col("g")) * F.col("copies")).alias("weight")))).alias("l")).select(
                "features", "l.*")
        model = LogisticRegression(maxIter=50, regParam=1e-4, weightCol="weight").fit(both)
        weights, bias = model.coefficients.toArray(), float(model.intercept)
    return {"base": base, "odds": odds, "weights": weights, "bias": bias}


def classified(docs: DataFrame, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """The rows with ``_label`` (posterior of the labellers), ``_score`` (the scorer's) and ``_keep``.

    Both are probabilities of good quality. A document goes if both are below one half: the scorer alone is
    unsure of words it has not met in its sample. A null or empty text has no votes and no features: its label and
    score come from the shares of good and bad documents alone. If the labellers see one quality only,
    the scorer gives every document their share. Rows that repeat get equal scores; a table without rows is
    returned without rows; other columns pass through, but that columns of the caller with these three names give
    way to them.
    """
    model = model or train(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("_label", "_score", "_keep")
    at = docs.columns.index(text_col)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, m = Words(batch.column(at)), shared.value
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(posterior(words.votes().astype(np.int64), m["base"], m["odds"])),
             pa.array(words.scores(m["weights"], m["bias"]))], names=[*batch.schema.names, "_label", "_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_label", T.DoubleType()),
                           T.StructField("_score", T.DoubleType())])
    return over_batches(docs, scan, schema).withColumn(
        "_keep", F.greatest("_score", "_label") >= KEEP_FROM)
