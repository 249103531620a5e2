"""Raking against its defining equations, and sampling against its expectation."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import mixing, queries

TARGETS = {"source": {"a": .5, "b": .2}, "lang": {"en": .6, "fr": .4}}


def test_margins_are_met():
    rng = np.random.default_rng(2)
    cells = [(s, la) for s in ("a", "b", "other") for la in ("en", "fr")]
    tokens = rng.integers(1, 1000, len(cells)).tolist()
    weights = mixing.rake(cells, tokens, TARGETS)
    for place, wanted in ((0, {"a": .5, "b": .2, "other": .3}), (1, {"en": .6, "fr": .4})):
        for value, share in wanted.items():
            assert abs(sum(w for c, w in zip(cells, weights) if c[place] == value) - share) < 1e-6
    odds = [w / t for w, t in zip(weights, tokens)]  # only products of row and column factors
    assert np.isclose(odds[0] * odds[3], odds[1] * odds[2])


def test_absent_values_and_bad_targets():
    assert np.allclose(mixing.rake([("a", "en")], [5], TARGETS), [1.0])
    assert len(mixing.rake([], [], TARGETS)) == 0
    with pytest.raises(ValueError):
        mixing.rake([("a", "en")], [5], {"source": {"a": .9, "b": .3}, "lang": {}})
    # no value of a dimension has tokens and a target: it constrains nothing
    free = mixing.rake([("other", "en"), ("other", "de")], [5, 15], {"source": {"a": 1.0}, "lang": {"en": .5, "de": .5}})
    assert np.allclose(free, [.5, .5])


def test_sample_follows_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 40)), str(rng.choice(["a", "a", "a", "b", "c", "d"])),
             str(rng.choice(["en", "en", "fr"])), "x") for i in range(20_000)]
    rows += [(None, None, None, None, None), (5, "", "a", "en", "x"), (6, rows[6][1], *rows[6][2:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens string")
    got = mixing.mixed(docs, TARGETS, {"source": F.col("source"), "lang": F.col("lang")})
    assert got.columns == [*docs.columns, "_tokens", "_expected", "_copies"]
    assert got.count() == len(rows)
    found = got.collect()
    total = sum(r["_tokens"] for r in found)
    drawn = sum(r["_tokens"] * r["_copies"] for r in found)
    assert abs(drawn / total - 1) < .02
    for column, shares in TARGETS.items():
        for value, share in shares.items():
            own = sum(r["_tokens"] * r["_copies"] for r in found if r[column] == value)
            assert abs(own / drawn - share) < .02
    assert all(abs(r["_copies"] - r["_expected"]) < 1 and r["_copies"] >= 0 for r in found)
    assert all(r["_copies"] == 0 for r in found if r["_tokens"] == 0)
    assert len({r["_copies"] for r in found if r["doc_id"] == 6}) == 1
    none = mixing.mixed(docs.limit(0), TARGETS, {"source": F.col("source"), "lang": F.col("lang")})
    assert none.collect() == []


def test_values_without_targets_are_drawn_too(spark):
    """Languages the mix does not name share what it leaves; a dimension without named values is left as it is."""
    docs = spark.createDataFrame([(i, "five words of plain prose", None, None if i % 2 else "xx") for i in range(50)],
                                 "doc_id long, text string, source string, lang string")
    got = queries.mixed_documents(docs).collect()
    assert sum(r["_expected"] * r["_tokens"] for r in got) == pytest.approx(250) and min(r["_expected"] for r in got) > 0
    named = spark.createDataFrame([(1, "a b c", "s", "en"), (2, "a b c", "s", "xx"), (3, "a b c", "s", "de")], docs.schema)
    shares = {r["lang"]: r["_expected"] for r in queries.mixed_documents(named).collect()}
    assert shares["xx"] == pytest.approx(3 * .04 / .70) and shares["en"] == pytest.approx(3 * .49 / .70)


def test_columns_with_clashing_names(spark):
    names = ["_tokens", "_expected", "_copies", "_cell_0", "cell_0", "row", "id", "tokens", "wanted", "total"]
    docs = spark.createDataFrame([(1, "a b", "s", "en", *range(10))], "doc_id long, text string, source string, lang string, "
                                 + ", ".join(f"{n} int" for n in names))
    row = queries.mixed_documents(docs).first()
    assert [row[n] for n in names[3:]] == [3, 4, 5, 6, 7, 8, 9] and row["_tokens"] == 2 and row["_copies"] == 1
