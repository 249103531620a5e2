"""Merkle manifests against the definition in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wardline.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, digest string, grp string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc, text):
    values = (doc[0], doc[3], doc[2], doc[4], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The top and, per node, its sibling lists (left, right) from the bottom."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i - i % 8:i - i % 8 + 8]
            ways[leaf].append((run[:i % 8], run[i % 8 + 1:]))
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0] if nodes else None, ways


def brute(docs):
    by_lang = {}
    for doc in docs:
        by_lang.setdefault(doc[2], []).append(doc)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    tops, below = [], []
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d, d[1])))
        top, ways = tree([leaf_of(d, d[1]) for d in own])
        tops.append(top)
        below.append((own, ways))
    root, above = tree(tops)
    rows = []
    for lang, (own, ways) in enumerate(below):
        for doc, way in zip(own, ways):
            way = way + above[lang]
            text, hit = doc[1], doc[0] is not None and zlib.crc32(str(doc[0]).encode()) % 3 == 0
            if hit and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = leaf_of(doc, text)
            for left, right in way:
                h = sha("".join(left) + h + "".join(right))
            proof = sha("".join("".join(left + right) for left, right in way))
            rows.append((doc[0], leaf_of(doc, doc[1]), tops[lang], root, proof, h, h == root))
    return sorted(rows, key=repr)


def query(spark, docs, tmp_path):
    spark.createDataFrame([(*d, 1, "x", "y") for d in docs], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


def documents(langs):
    rng = random.Random(5)
    docs, number = [], 0
    for lang, count in langs.items():
        for _ in range(count):
            docs.append((number * 7 % 1009, rng.choice(["Plain Text ", "ÄÖ low ", "", "X" * 5000]) + str(number), lang,
                         rng.choice(["a", None, "é"]), rng.choice([3, None])))
            number += 1
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("langs", [
    {"en": 150, "de": 64, "fr": 8, "es": 9, None: 1, "": 2, "é": 1, "z": 7, "=": 3},
    {"en": 65}, {"en": 1}, {"en": 1, None: 1}, {f"l{i}": 1 for i in range(70)}], ids=str)
def test_equals_brute_force(spark, tmp_path, langs):
    docs = documents(langs)
    assert query(spark, docs, tmp_path) == brute(docs)


def test_nulls_ties_and_repeated_rows(spark, tmp_path):
    docs = documents({"en": 30}) + [(3, None, "en", None, None), (None, "No id", "en", "a", 1), (None, None, None, None, None)]
    docs += [docs[0]] * 20 + [(docs[0][0], "another text of this id", "en", "a", 1)]
    assert query(spark, docs, tmp_path) == brute(docs)


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


def test_other_fanout_and_order(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(5)], "k long, v string")
    found = merkle.manifest(rows.withColumn("g", F.lit(1)), merkle.leaf_digest([F.col("v")]), "k", "g", fanout=2)
    a = [sha(f"1:{i}") for i in range(5)]
    pairs = [sha(a[0] + a[1]), sha(a[2] + a[3]), sha(a[4])]
    fours = [sha(pairs[0] + pairs[1]), sha(pairs[2])]
    got = {r["id"]: r for r in found.withColumn("text", merkle.proof_text(F.col("path"))).collect()}
    assert {r["root"] for r in got.values()} == {sha(fours[0] + fours[1])}
    assert got[2]["text"] == a[3] + pairs[0] + fours[1] and got[4]["text"] == "" + fours[0]


def test_no_python_in_the_plan(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = merkle.manifest(docs, merkle.document_leaf(F.col("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
