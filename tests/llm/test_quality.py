"""Quality classifier: labellers and EM on planted votes, and held-out accuracy on the labelled documents."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from wardline.llm import quality


def test_votes():
    texts = ["plain words stand here, one after another, and no two of them say it like the rest do at all today",
             "this# is$ full% of& marks* here^", "SHOUTED WORDS EVERYWHERE HERE", "wow!! so!! loud!!",
             "a | b | c | d", "no no no no no no no", "", None]
    votes = {t: dict(zip(quality.LABELLERS, v)) for t, v in zip(texts, quality.Words(pa.array(texts)).votes().tolist())}
    assert set(votes[texts[0]].values()) == {1}
    for text, labeller in zip(texts[1:6], quality.LABELLERS):
        assert votes[text][labeller] == -1
    assert set(votes[""].values()) == set(votes[None].values()) == {0}


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < .8
    hit = np.array([.9, .6, .7])      # share of bad documents each labeller calls bad
    wrong = np.array([.02, .01, .05])  # share of good ones
    bad_vote = rng.random((20_000, 3)) < np.where(good[:, None], wrong, hit)
    votes = np.where(bad_vote, -1, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    base, odds = quality.accuracies(patterns, counts.astype(float), bad_odds=0.0, good_odds=math.inf)
    assert abs(base - math.log(.8 / .2)) < .15
    assert np.allclose(odds[:, 0], np.log(wrong / hit), atol=.4)


def test_the_fast_way_agrees():
    for word in ("word", "Word", "WORD", "a", "A", "Ab", "aB", "été", "Été,", "ÉTÉ.", "don't", "x1", "a!!", "|", "...", "é;",
                 ",", "iPhone:", "ß", "日本", "日本."):
        found, shape = quality.known_of(word)
        assert shape == quality._shape(word), word
        assert found == (quality.SYMBOLS.search(word) is not None, len(word) > 1 and word.isupper(),
                         quality.EXCLAIMED.search(word) is not None, not any(map(str.isalnum, word)),
                         quality.PLAIN.fullmatch(word) is not None), word


def test_a_rare_kind_is_not_outvoted():
    """Two labellers that know a rare kind of badness, against five that do not object."""
    patterns = np.array([[1, 1, 1, 1, 1, 1, 1], [-1, 1, 1, 1, 1, -1, 1], [1, 1, 1, 1, -1, 1, -1]])
    base, odds = quality.accuracies(patterns, np.array([114.0, 30, 6]))
    assert (quality.posterior(patterns, base, odds) > .5).tolist() == [True, False, False]


def test_accuracy_on_labels(spark):
    """The labels are never trained on: all labelled documents are held out."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = quality.classified(docs).join(labels, "doc_id").select("quality", "_keep", "_label").collect()
    assert sum(r["_keep"] == (r["quality"] == 1) for r in rows) >= .97 * len(rows)
    assert not [r for r in rows if r["quality"] == 1 and not r["_keep"]]


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 50_000, "c"), (4, "two words", "d"), (4, "two words", "d"), (None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes string")
    got = quality.classified(docs)
    assert got.columns == ["doc_id", "text", "votes", "_label", "_score", "_keep"]
    found = got.collect()
    assert len(found) == 6 and all(0 <= r["_score"] <= 1 for r in found)
    assert len({r["_score"] for r in found if r["doc_id"] == 4}) == 1
    assert quality.classified(docs.limit(0)).collect() == []


def test_one_quality_only(spark):
    docs = spark.createDataFrame([(i, "these are some plain words") for i in range(20)], "doc_id long, text string")
    assert all(r["_keep"] for r in quality.classified(docs).collect())


def test_a_hot_text_does_not_fill_the_sample(spark, monkeypatch):
    """A third of the rows has one text, once with ids of their own and once with one id."""
    sizes = []
    fit = quality.LogisticRegression.fit
    monkeypatch.setattr(quality.LogisticRegression, "fit", lambda self, rows: (sizes.append(rows.count()), fit(self, rows))[1])
    rows = [(i, f"plain words number {i} of a text " * 3 if i % 2 else "&&& *** %%% ### " * 5) for i in range(4000)]
    for hot in ([(5000 + i, "the same &&& *** text") for i in range(2000)], [(5000, "the same &&& *** text")] * 2000):
        docs = spark.createDataFrame(rows + hot, "doc_id long, text string").repartition(4)
        quality.train(docs, sample_rows=300)
    assert len(sizes) == 2 and max(sizes) <= 2 * 450  # two weighted rows for each vector


def test_columns_with_clashing_names(spark):
    names = ["_label", "_score", "_keep", "n", "sampled", "votes", "vector", "copies"]
    docs = spark.createDataFrame([(i, "some plain words of a text", *range(8)) for i in range(3)],
                                 "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    row = quality.classified(docs).first()
    assert [row[n] for n in names[3:]] == [3, 4, 5, 6, 7] and row["_keep"] is True


def test_long_words_are_told_whole():
    assert quality._shape("a" * 50 + "&" * 3 + "A9") == "aa&&A0" and quality._shape("a1" * 30) == "a0" * 30
