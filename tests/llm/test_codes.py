"""Vector codes against all distances in plain Python, and the tree against a scan."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from wardline.llm import codes, queries

SCHEMA = "vec_id long, embedding array<float>, label int, codes int, v string"


def brute(rows):
    """Codes of (vec_id, vector, label) as the definition states them."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    width = len(kept[0][1]) // 8
    books = [[list(v[p * width:(p + 1) * width]) for _, v, _ in kept[:16]] for p in range(8)]

    def nearest(p, v):
        part = v[p * width:(p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        for p in range(8):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(p, v)[1], []).append(v[p * width:(p + 1) * width])
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [(i, [nearest(p, v) for p in range(8)], label) for i, v, label in kept]
    total = {}
    for _, parts, label in found:
        total[label] = total.get(label, 0) + sum(d for d, _ in parts)
    return sorted(((i, "".join(f"{k:02x}" for _, k in parts), sum(d for d, _ in parts), total[label], digest)
                   for i, parts, label in found), key=repr)


def query(spark, rows, tmp_path):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    frame.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return sorted((tuple(r) for r in queries.op11_vector_codes(spark, str(tmp_path)).collect()), key=repr)


def floats(values):
    return [float(np.float32(x)) for x in values]


def test_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(i), floats(rng.normal(size=16) * rng.choice([.01, .2, 3])), rng.choice([0, 1, None]))
            for i in rng.permutation(200)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(60)]  # copies, ties
    rows += [(-1, None, 1), (-2, floats([1.0] * 15 + [np.nan]), 1), (-3, floats([np.inf] * 16), 0), (-4, [None] * 16, 0)]
    assert query(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("count", [1, 3, 17])
def test_few_vectors_and_equal_entries(spark, tmp_path, count):
    rows = [(i, floats([i % 2, -.0001] * 4), None) for i in range(count)]
    assert query(spark, rows, tmp_path) == brute(rows)


def test_empty_tables_and_odd_lengths(spark, tmp_path):
    assert query(spark, [], tmp_path / "a") == []
    assert query(spark, [(1, None, 1), (2, [], 1)], tmp_path / "b") == []
    found = query(spark, [(1, floats([.5] * 9), 1), (2, floats([.5] * 17), 1), (None, floats([.25] * 9), 1),
                          (1, floats([.5] * 9), 1), (3, floats([3e38] * 9), 2)], tmp_path / "c")
    assert [(r[0], r[2]) for r in found] == [(1, 0), (1, 0), (3, 0), (None, 0)]  # the length of the first vector counts


@pytest.mark.parametrize("entries,width,spread", [(16, 8, 500), (256, 8, 500), (256, 3, 4), (300, 1, 3), (64, 8, 0)])
def test_tree_equals_scan(entries, width, spread):
    rng = np.random.default_rng(entries + width)
    middles = rng.integers(-9000, 9000, (12, width)) * (spread > 4)
    book = middles[rng.integers(0, 12, entries)] + rng.integers(-spread, spread + 1, (entries, width))
    asked = np.concatenate([book, middles[rng.integers(0, 12, 2000)] + rng.integers(-spread, spread + 1, (2000, width))])
    distances = codes.squares(asked, book)
    nearest, best = codes.nearest_entries(codes.Gnat.build(book), asked)
    assert (nearest == distances.argmin(axis=1)).all() and (best == distances.min(axis=1)).all()


def test_subtrees_are_left_out():
    rng = np.random.default_rng(1)
    middles = rng.integers(-90_000, 90_000, (16, 8))
    book = np.repeat(middles, 16, axis=0) + rng.integers(-50, 51, (256, 8))
    asked = middles[rng.integers(0, 16, 1000)] + rng.integers(-50, 51, (1000, 8))
    best, nearest = np.full(1000, 2**62), np.full(1000, 2**62)
    seen = codes.Gnat.build(book).search(asked, best, nearest, np.arange(1000))
    assert seen < 256_000 / 3


def test_bounds_hold_for_large_integers():
    for value in [0, 1, 2, 3, 10**6, 2**53 + 1, 2**60 + 12345]:
        square = np.array([value])
        assert root(codes.root_below(square)[0]) <= value <= root(codes.root_above(square)[0])


def root(x):
    from fractions import Fraction
    return Fraction(float(x)) ** 2
