"""Benchmark decontamination against a scan of all diagonals."""

from __future__ import annotations

import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import leaks


def brute_span(equal):
    best = 0
    for i in range(len(equal)):
        for j in range(i + 1, len(equal) + 1):
            if equal[i] and equal[j - 1] and sum(equal[i:j]) >= .8 * (j - i):
                best = max(best, j - i)
    return best


def brute(docs, items, min_words=12):
    found = {}
    for doc, text in docs:
        w = (text or "").lower().split()
        found[doc] = set()
        for item, other in items:
            v = (other or "").lower().split()
            for shift in range(-len(v) + 1, len(w)):
                equal = [w[i] == v[i - shift] for i in range(max(0, shift), min(len(w), len(v) + shift))]
                if v and sum(equal) >= .8 * min(min_words, len(v)) and brute_span(equal) >= min(min_words, len(v)):
                    found[doc].add(item)
    return found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=40))
def test_best_span(equal):
    span = leaks.best_span(np.array(equal, bool), .8)
    assert (span[1] - span[0] if span else 0) == brute_span(equal)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 10, 20, 60])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "same " * 30), (93, items[4][1]), (None, items[3][1])]
    docs = []
    for d in range(60):
        text = rng.choices(words, k=rng.choice([0, 5, 80, 300]))
        for _ in range(rng.randrange(3)):
            v = rng.choice(items[:25])[1].split()
            v = [rng.choice(words) if rng.random() < rng.choice([0, .05]) else x for x in v]
            at = rng.randrange(len(text) + 1)
            text[at:at] = v[:rng.choice([8, 15, 60])]
        docs.append((d, rng.choice([" ", "\n ", "\t"]).join(text).upper()))
    docs += [(200, None), (201, ""), (202, "same " * 4000), (203, " ".join(words) * 3 + " " + items[5][1])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [x for x in items if x[0] is not None])
    for block_words in (150, 10**6):
        got = {r["doc_id"]: r for r in leaks.leaks(frame, bench, block_words=block_words, piece_words=200).collect()}
        assert {d: set(r["_items"]) for d, r in got.items()} == want
        assert all(s["equal"] >= .8 * s["words"] for r in got.values() for s in r["_spans"])


def test_every_placement_of_substitutions_is_found():
    """Up to a fifth of 12 to 16 words changed, and two or four of up to 20, in a text whose other words differ."""
    item = np.arange(1, 21, dtype=np.uint64)
    for size in range(12, 21):
        block = leaks.Block([(7, size, " ".join(f"t{i}" for i in range(size)))], leaks.MASKS, 12)
        most = size // 5 if size <= 16 or size == 20 else 2
        for changed in itertools.combinations(range(1, size - 1), most):
            words = np.concatenate([item[:5] + np.uint64(900), block.words, item[:5] + np.uint64(950)])
            words[5 + np.array(changed)] = 1
            found = list(block.overlaps(words, np.array([0, len(words)])))
            assert found == [(0, 7, 5, size, size - most)], (size, changed)


def test_long_items_are_compared_in_pieces(spark):
    rng = random.Random(2)
    long = [f"t{i}" for i in range(5000)]
    docs = [(i, " ".join(rng.choices(["x", "y"], k=9) + long[at:at + 14])) for i, at in enumerate((0, 90, 197, 3111, 4986))]
    bench = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench, piece_words=200).collect()
    assert all(r["_items"] == [1] and max(s["words"] for s in r["_spans"]) == 14 for r in got)


def test_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["_items"] for r in leaks.leaks(docs, none).collect()] == [[], [], []]
    assert leaks.leaks(docs.limit(0), none).collect() == []


def test_runs_that_an_item_repeats(spark):
    """Overlaps whose only seeds are runs that stand in the item before already, and items of few different words."""
    rng = random.Random(21)
    a, b = [f"a{i}" for i in range(4)], [f"b{i}" for i in range(6)]
    fill = [[f"f{k}{i}" for i in range(20)] for k in range(3)]
    items = [(1, " ".join(a + fill[0] + b + fill[1] + a + ["q", "r"] + b))]
    docs = [(1, " ".join(fill[2] + a + ["x", "y"] + b + ["end"]))]
    for n in range(25):
        few = [f"v{i}" for i in range(rng.choice([2, 3, 6]))]
        items.append((10 + n, " ".join(rng.choice(few) for _ in range(rng.choice([14, 40, 90])))))
        docs.append((10 + n, " ".join(rng.choice(few + ["z"]) for _ in range(rng.choice([20, 60])))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: set(r["_items"]) for r in leaks.leaks(frame, benchmark).collect()}
    assert got == brute(docs, items) and got[1] == {1}


def test_hits_are_cut_before_they_are_made(monkeypatch):
    """One word over and over in texts and items: a part of the hits is held at a time, whatever their number."""
    sizes = []
    dense = leaks.Block.dense
    monkeypatch.setattr(leaks, "HITS", 1000)
    monkeypatch.setattr(leaks.Block, "dense", lambda self, place, *rest: (sizes.append(len(place)), dense(self, place, *rest))[1])
    block = leaks.Block([(1, 3000, "same " * 3000)], leaks.MASKS, 12)
    values, starts = leaks.split_words(leaks.pa.array(["same " * 500, "other"]))
    spans = list(block.overlaps(leaks.word_hashes(values), starts))
    assert max(sizes) <= 1000 and max(s[3] for s in spans) == 500 and {s[0] for s in spans} == {0}


def test_columns_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    names = ["_row", "_text", "_spans", "_items", "text_", "item", "start", "words"]
    docs = spark.createDataFrame([(1, text, *range(8))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    benchmark = spark.createDataFrame([(5, text)], "item_id long, text string")
    row = leaks.leaks(docs, benchmark).first()
    assert row["_items"] == [5] and [row[n] for n in ("_row", "_text", "item", "words")] == [0, 1, 5, 7]
