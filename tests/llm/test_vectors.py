"""Embedding near-duplicates against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from wardline.llm import vectors


def brute(rows):
    units = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
        w = np.array(v, np.float64) if ok else None
        units.append(w / np.linalg.norm(w) if ok and np.linalg.norm(w) > 0 else None)
    n, names, links = len(rows), list(range(len(rows))), [0] * len(rows)
    for i in range(n):
        for j in range(i):
            if (units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2]
                    and len(units[i]) == len(units[j]) and units[i] @ units[j] >= .98):
                links[i] += 1
                links[j] += 1
                old, new = names[i], names[j]
                names = [new if x == old else x for x in names]
    least = {}
    for (vec, _, _), name in zip(rows, names):
        least[name] = min(least.get(name, vec), vec)
    return sorted((r[0], k, least[m], r[0] == least[m]) for r, k, m in zip(rows, links, names))


@pytest.mark.parametrize("cell_rows,block_rows", [(20, 7), (100, 1000), (2000, 1000)])
def test_equals_brute_force(spark, cell_rows, block_rows):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append((base + rng.normal(size=16) * .06, int(i % 3)))
    rows += [(rows[0][0], rows[0][1])] * 5 + [(rows[0][0] * 3, rows[0][1]), (rows[0][0], None), (None, 1)]
    rows += [(np.zeros(16), 1), (np.array([1.0, np.nan]), 1), (np.array([np.inf, 1]), 1), (np.array([]), 0)]
    rows += [(np.array([3.0, 4.0]), 1), (np.array([3.0, 4.001]), 1)]
    rows = [(int(k), None if v is None else [float(np.float32(x)) for x in v], label)
            for k, (v, label) in zip(rng.permutation(len(rows)), rows)]
    frame = spark.createDataFrame([(*r, 1) for r in rows],
                                  "vec_id long, embedding array<float>, label int, node int")
    got = vectors.near_duplicates(frame, cell_rows=cell_rows, block_rows=block_rows).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_null_components_and_ids(spark):
    frame = spark.createDataFrame([(1, [1.0, None], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)],
                                  "vec_id long, embedding array<float>, label int")
    got = {r["id"]: (r["n_links"], r["component"], r["kept"]) for r in vectors.near_duplicates(frame).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), None: (0, None, None)}
    assert vectors.near_duplicates(frame.limit(0)).collect() == []
