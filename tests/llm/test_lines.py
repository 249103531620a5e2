"""Line deduplication against its definition in plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest

from wardline.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    first, seen = {}, {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key_of(line)) >= 10:
                seen.setdefault(key_of(line), set()).add(doc)
    first = {k: min(v) for k, v in seen.items() if len(v) > 1}
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if doc is None or doc <= first.get(key_of(x), doc)]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [3, 100_000])
def test_equals_brute_force(spark, hot_rows):
    rng = random.Random(1)
    pool = [f"Line number {i} of all" for i in range(60)] + ["short", "", " ", "ten chars!", "nine char"]
    pool += ["ÉCOLE DES LIGNES", "éCOLE DES LIGNES", "École des lignes", "  padded line here\t", "PADDED line here\r"]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t", " own " + str(rng.random())])
                          for _ in range(rng.choice([0, 1, 5, 200])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, pool[0]), (None, "x"), (7, rows[7][1]), (8, pool[3]),
             (103, "only once in the table " * 4000), (104, "\n".join(pool[i % 60] for i in range(5000)))]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 1, "h") for d, t in rows],
                                 "doc_id long, text string, pos int, h1 string")
    got = lines.deduplicated(docs, hot_rows=hot_rows)
    assert got.columns == ["doc_id", "text", "pos", "h1", "_lines", "_dropped", "_kept"]
    found = [(r["doc_id"], r["_lines"], r["_dropped"], r["_kept"]) for r in got.collect()]
    assert sorted(found, key=repr) == brute(rows)


def test_bitmap_holds_one_bit_a_line(spark):
    rows = spark.createDataFrame([(1, 9, p) for p in (0, 63, 64, 200, 200)], "id long, part long, pos int")
    bits = lines.keep_bitmaps(rows).first()["dropped"]
    assert [b % 2**64 for b in bits] == [1 | 1 << 63, 1, 0, 1 << 8]


def test_empty_table_and_no_python(spark, data):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.deduplicated(docs).collect() == []
    plan = lines.deduplicated(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_kept_hash_of_nothing(spark):
    docs = spark.createDataFrame([(1, "the same line"), (2, "the same line")], "doc_id long, text string")
    kept = {r["doc_id"]: r["_kept"] for r in lines.deduplicated(docs).collect()}
    assert kept == {1: "the same line", 2: ""} and hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_columns_with_clashing_names(spark):
    names = ["id", "part", "dropped", "row", "own_id", "own_text", "_bitmap_id", "_lines", "_kept", "first"]
    docs = spark.createDataFrame([(n, "the same long line", *range(10)) for n in (1, 2)],
                                 "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = {r["doc_id"]: r for r in lines.deduplicated(docs).collect()}
    assert got[2]["_kept"] == "" and got[1]["_kept"] == "the same long line" and got[2]["_lines"] == 1
    assert [got[2][n] for n in names if not n.startswith("_l") and n != "_kept"] == [0, 1, 2, 3, 4, 5, 6, 9]
