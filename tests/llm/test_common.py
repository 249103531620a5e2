"""Words of Arrow batches, slices included, and components against a union of sets."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from wardline.llm.common import Scratch, components, split_words


@pytest.mark.parametrize("lower", [True, False])
def test_words_of_slices(lower):
    texts = [None, "", "  Ä b\tC ", "É\x0bÉ x", "one", "\n"] * 30
    batch = pa.array(texts)
    for at in range(0, 150, 7):
        values, starts = split_words(batch.slice(at, 20), lower)
        values.validate(full=True)
        words = values.to_pylist()
        got = [words[a:b] for a, b in zip(starts[:-1], starts[1:])]
        want = [(t or "").encode() for t in texts[at:at + 20]]
        assert got == [[w.decode() for w in (t.lower() if lower else t).split()] for t in want]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1100)]
    edges += [(2000, i) for i in range(1900, 2100)] + [(5, 5)]
    names = {n: n for e in edges for n in e if e[0] != e[1]}
    for a, b in edges:
        if a != b and names[a] != names[b]:
            low, high = sorted((names[a], names[b]))
            names = {n: low if v == high else v for n, v in names.items()}
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "components")).collect()
    assert {(r["node"], r["label"]) for r in got} == set(names.items())
