"""Token counts against a segmentation of each word on its own."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import tokens


def brute(word, scores):
    """Best (score, -tokens) of a word, over all ways to cut it."""
    unknown = min(scores.values(), default=0) - 10_000_000
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        ways = [(best[i][0] + scores[word[i:end]], best[i][1] - 1) for i in range(end) if word[i:end] in scores]
        if word[end - 1] not in scores:
            ways.append((best[end - 1][0] + unknown, best[end - 1][1] - len(word[end - 1].encode())))
        best.append(max(ways))
    return -best[-1][1]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abcé", min_size=1, max_size=4), st.integers(-30, -1), min_size=1),
       st.lists(st.text("abcdé", min_size=1, max_size=12), min_size=1), st.integers(1, 40))
def test_trie_equals_brute_force(scores, words, max_nodes):
    trie = tokens.Trie(scores, max_nodes)
    for word in words:
        assert trie.count(word) == brute(word, scores) == trie._unstored(word)


def test_prefixes_are_computed_once():
    trie = tokens.Trie({"a": -1, "ab": -2})
    for word in ("abab", "abab", "aba", "ababa", "b"):
        trie.count(word)
    assert trie.computed == len({"a", "ab", "aba", "abab", "ababa", "b"})


def test_counts_of_documents(spark, data):
    scores = tokens.unigram_scores()
    rng = random.Random(1)
    texts = [None, "", " \n", "Ein Wort", "ein  Wort\tund 漢字 😀", "x" * 1200, "a b " * 20_000]
    texts += [" ".join("".join(rng.choices("etaoiné", k=rng.randrange(1, 9))) for _ in range(50)) for _ in range(20)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "null id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int")
    got = sorted(map(tuple, tokens.token_counts(docs).collect()), key=repr)
    memo = {}
    for t in texts + ["null id"]:
        for w in (t or "").split():
            memo.setdefault(w, brute("▁" + w, scores))
    want = [(i, len((t or "").split()), sum(memo[w] for w in (t or "").split())) for i, t, _ in rows]
    assert got == sorted(want, key=repr)
    assert tokens.token_counts(docs.limit(0)).collect() == []
    total = tokens.token_counts(spark.read.parquet(f"{data}/documents.parquet"))
    assert total.where("tokens < words").count() == 0
