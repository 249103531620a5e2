"""Byte-level BPE against tiktoken, and round trips."""

from __future__ import annotations

import random

import pytest
import regex
import tiktoken

from wardline.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def theirs(vocabulary):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    ranges = [(32, 127), (0, 0x250), (0x400, 0x500), (0x3000, 0x9000), (0x1F300, 0x1F700), (9, 14)]
    chars = [chr(rng.randrange(*rng.choice(ranges))) for _ in range(400)] + [" "] * 80 + ["\x1c", "\x85", "\xa0", " "]
    mixed = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(800)]
    runs = ["".join(rng.choice("abcde") for _ in range(rng.randrange(90))) for _ in range(400)]
    long = ["=" * 3001, "aaab" * 500, " " * 2000 + "x", "\n" * 777, "".join(rng.choice("abcdefghij") for _ in range(900))]
    return mixed + runs + long + ["a" * n for n in range(0, 300, 7)] + ["", "it's <|endoftext|> I'll", "ends in spaces   "]


def test_equals_tiktoken(vocabulary, theirs):
    split = regex.compile(bpe.PATTERN)
    cases = texts()
    coder = bpe.Coder(vocabulary)
    got = coder.ids([split.findall(text) for text in cases])
    assert got == [theirs.encode_ordinary(text) for text in cases]
    small = bpe.Coder(vocabulary, known_words=50, state_rows=5_000)  # forgets, and goes on from the last state
    assert [ids for k in range(0, len(cases), 100)
            for ids in small.ids([split.findall(text) for text in cases[k:k + 100]])] == got


def test_ranks_without_order(theirs):
    """Pairs of lower rank that only appear after a contraction."""
    tokens = {bytes([i]): i for i in range(256)}
    for number, token in enumerate([b"pq", b"qb", b"qbx", b"pqbx", b"xx", b"pqb", b"bp", b"pqbpqb", b"xpq"]):
        tokens[token] = 256 + number
    swapped = bpe.Vocabulary({rank: token for token, rank in tokens.items()})
    other = tiktoken.Encoding("odd", pat_str=bpe.PATTERN, mergeable_ranks=tokens, special_tokens={})
    rng = random.Random(8)
    words = {"".join(rng.choice("pqbx") for _ in range(rng.randrange(1, 120))) for _ in range(500)}
    words |= {"pqb" * n for n in range(1, 60)}
    got = bpe.Coder(swapped).encode(sorted(words))
    assert {w: list(ids) for w, ids in got.items()} == {w: other.encode_ordinary(w) for w in words}


def test_round_trip_of_the_table(spark, data, theirs):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["id"]: r for r in bpe.decoded(bpe.encoded(docs)).collect()}
    for doc in docs.collect():
        text = doc["text"] or ""
        assert rows[doc["doc_id"]]["ids"] == theirs.encode_ordinary(text)
        assert bytes(rows[doc["doc_id"]]["bytes"]) == text.encode()


def test_nulls_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "a b", 5), (3, "a b", 5)],
                                 "doc_id long, text string, ids int")
    got = sorted(((r["id"], r["ids"], bytes(r["bytes"])) for r in bpe.decoded(bpe.encoded(docs)).collect()), key=repr)
    assert got == [(1, [], b""), (2, [], b""), (3, [64, 275], b"a b"), (3, [64, 275], b"a b"), (None, [64, 275], b"a b")]
    assert bpe.decoded(bpe.encoded(docs.limit(0))).collect() == []


def test_decoding_what_is_no_token(spark):
    rows = spark.createDataFrame([(1, [64, 50256]), (2, [64, None]), (3, None), (4, [275, 64]), (5, [])],
                                 "id long, ids array<int>")
    got = {r["id"]: r["bytes"] for r in bpe.decoded(rows).collect()}
    assert got == {1: None, 2: None, 3: b"", 4: b" ba", 5: b""}
