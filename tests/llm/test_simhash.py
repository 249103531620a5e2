"""SimHash near-duplicates against brute force over all pairs."""

from __future__ import annotations

import random

import pytest
import xxhash

from wardline.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
             .replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ")
             .replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_fingerprint(text) for _, text in rows]
    names = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                old, new = names[i], names[j]
                names = [new if n == old else n for n in names]
    least = {}
    for (doc, _), n in zip(rows, names):
        if doc is not None:
            least[n] = min(least.get(n, doc), doc)
    return sorted(((doc, p, least.get(n)) for (doc, _), p, n in zip(rows, prints, names)), key=repr)


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("small", [2, 64])
def test_equals_brute_force(spark, small):
    rng = random.Random(3)
    words = [f"Wort{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(200)]
        rows.append(" ".join(base))
        for _ in range(14):  # near copies, links through chains included
            other = list(base)
            for _ in range(rng.randrange(3)):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append("  ".join(other) if rng.random() < .5 else "\n".join(other).upper())
    rows += [None, "", " \t", "one", "one two", "ONE  two", "É ß   x", "x" * 5000, "a b c " * 9000]
    rows = [(i * 7 % 1009, text) for i, text in enumerate(rows)]
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, "nobody else says this")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, label int")
    got = sorted(((r["id"], r["fp"], r["component"]) for r in simhash.near_duplicates(docs, small=small).collect()),
                 key=repr)
    want = sorted(((d, signed(p), c) for d, p, c in brute_components(rows)), key=repr)
    assert got == want


def test_links_of_a_crowded_group(spark):
    """Fingerprints around one centre, many to a variant group: the links join what brute force joins."""
    rng = random.Random(5)
    prints = {0x0123456789ABCDEF}
    while len(prints) < 150:
        near = rng.choice(sorted(prints)) ^ 1 << rng.randrange(12)
        prints.add(near ^ 1 << rng.randrange(12) if rng.random() < .5 else near)
    prints |= {rng.getrandbits(63) for _ in range(50)}
    frame = spark.createDataFrame([(p, p) for p in sorted(prints)], "fp long, least long")
    from wardline.llm.common import Scratch, components
    got = {(r["node"], r["label"]) for r in components(
        simhash.links(frame, Scratch(spark, "t"), small=8), Scratch(spark, "t")).collect()}
    names = {p: p for p in prints}
    for p in sorted(prints):
        for q in sorted(prints):
            if bin(p ^ q).count("1") <= 2 and names[p] != names[q]:
                low, high = sorted((names[p], names[q]))
                names = {k: low if v == high else v for k, v in names.items()}
    groups = {p for p in prints if any(q != p and names[q] == names[p] for q in prints)}
    assert got == {(p, names[p]) for p in groups}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for _ in range(15):
        base = rng.choices(words, k=150)
        rows += [" ".join(base), " ".join(base).upper(), " ".join(base[:-1] + [rng.choice(words)])]
    rows += [None, "", " \t", "one", "ONE"]
    rows = [(i * 7 % 1009, text) for i, text in enumerate(rows)]
    components = {(d, p): c for d, p, c in brute_components(rows)}
    docs = spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in rows], "doc_id long, text string, fp string, id int, part int, label int")
    got = simhash.without_near_copies(docs.repartition(5))
    assert got.columns == docs.columns and got.select("fp", "id", "part", "label").distinct().collect() == [("x", 1, 2, 3)]
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({c for c in components.values()})
    assert simhash.without_near_copies(docs.limit(0)).collect() == []


def test_repeated_ids_with_other_texts(spark):
    one, two = (" ".join(f"{side}{i}" for i in range(60)) for side in "ab")
    rows = [(5, one), (5, one), (5, two), (3, two), (9, one.upper()), (None, one), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.without_near_copies(docs).collect()), key=repr)
    assert got == [(3, two), (5, one), (None, one), (None, "alone")]
    same = spark.createDataFrame([(4, "a b c"), (4, "a  b c"), (6, "A b C")], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.without_near_copies(same).collect()] == [4]  # one text of the group's least id
