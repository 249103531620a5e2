"""Properties that hold for any text."""

from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.functions import pii
from wardline.functions.scorers import TOXIC_WORDS, LexiconToxicity
from wardline.functions.text import stripped
from wardline.operators import cache, engine

# surrogates cannot be stored, the noncharacters mark entities
ANY_TEXT = st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00\ufdd0\ufdd1\ufdd2"), max_size=60)
PARTS = st.sampled_from(["a@b.com", "x.y@mail.example.org", "555-123-4567", "+1 (555) 123-4567", " ", "-", "@", ".",
                         "word", "idiot", "Stupid", "\n", "7"])
MIXED = st.lists(PARTS, max_size=12).map("".join)
QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)


@QUICK
@given(st.lists(ANY_TEXT, min_size=20, max_size=40))
def test_stripped_like_python(spark, texts):
    rows = frame(spark, texts).select("id", stripped(F.col("text")).alias("s")).collect()
    assert [r["s"] for r in sorted(rows)] == [t.strip() for t in texts]


@QUICK
@given(st.lists(MIXED, min_size=20, max_size=40))
def test_redaction_removes_every_entity(spark, texts):
    once = frame(spark, texts).select("id", pii.pii_entities(F.col("text")).alias("e"),
                                      pii.pii_redacted(F.col("text")).alias("text"))
    for row in once.collect():
        assert bool(row["e"]) == (row["text"] != texts[row["id"]])
        tags = re.findall(r"\[(EMAIL|PHONE)_REDACTED\]", row["text"])
        assert [e.split(":")[0] for e in row["e"]] == tags


@QUICK
@given(st.lists(MIXED, min_size=20, max_size=40))
def test_score_counts_different_toxic_words(spark, texts):
    rows = frame(spark, texts).select("id", LexiconToxicity().score(F.col("text")).alias("s")).collect()
    for row in rows:
        words = set(re.split(r"[^a-z]+", texts[row["id"]].lower()))
        assert row["s"] == 1 - 0.5 ** len(words & set(TOXIC_WORDS))


@QUICK
@given(st.lists(MIXED, min_size=10, max_size=20))
def test_reuse_changes_no_verdict(spark, texts):
    df = frame(spark, texts + texts).withColumn("cache_key", F.md5("text"))

    def score(table):
        return engine.validate(table, "strict").select(*table.columns, "valid", "processed_text")

    plain = {r["id"]: (r["valid"], r["processed_text"]) for r in score(df).collect()}
    reused = cache.score_once(df, score, "id").collect()
    assert {r["id"]: (r["valid"], r["processed_text"]) for r in reused} == plain
    assert sum(not r["cache_hit"] for r in reused) == len(set(texts))
