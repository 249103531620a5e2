"""The pipeline against a brute-force version of every stage on a small corpus."""

from __future__ import annotations

import hashlib
import os
import random

import corpus_pipeline
from tests.llm.test_leaks import brute as brute_leaks
from tests.llm.test_lines import key_of
from tests.llm.test_simhash import brute_components
from wardline.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    """Rows, the ids planted as bad, and benchmark items."""
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(3, 9))) for _ in range(3000)]

    def lines(n):
        return "\n".join(" ".join(rng.choices(words, k=rng.randrange(6, 14))) for _ in range(n))

    items = [(i, " ".join(rng.choices(words, k=25))) for i in range(6)]
    texts, bad = [], set()
    for i in range(150):
        text = lines(rng.randrange(2, 9))
        if i % 10 == 3:
            text = " ".join(w + rng.choice(["&&&", "***", "%%%"]) for w in text.split())
        elif i % 10 == 6:
            text = " | ".join(text.split())
        elif i % 25 == 4:
            text = " ".join([rng.choice(words)] * 60)
        if i % 10 in (3, 6) or i % 25 == 4:
            bad.add(i)
        elif i % 12 == 1:
            text += "\n" + items[i % 6][1] + "\n" + lines(1)
        elif i % 12 == 5:
            text += "\nLicensed to all who read this far in 2024"
        elif i % 12 == 7 and i > 20:
            text = texts[i - 20] if i - 20 not in bad else text
        texts.append(text)
    rows = [(i, t, rng.choice(["en", "en", "de", "fr", None]), rng.choice(["src0", "src0", "src1", "src2", None]), len(t))
            for i, t in enumerate(texts)]
    return rows, bad, items


def brute_lines(rows):
    first = {}
    for doc, text, *_ in rows:
        for key in {key_of(x) for x in text.split("\n")}:
            if len(key) >= 10:
                first.setdefault(key, []).append(doc)
    out = []
    for doc, text, lang, source, _ in rows:
        kept = "\n".join(x for x in text.split("\n") if min(first.get(key_of(x), [doc])) == doc)
        out.append((doc, kept, lang, source, len(kept)))
    return out


def brute_mix(rows, sweeps=12):
    def topic(text):
        return ("legal" if "icense" in text else "contact" if "@" in text
                else "records" if any(text[i:i + 4].isdigit() for i in range(len(text) - 3)) else "prose")

    def cell(row):
        return (row[3] if row[3] in queries.MIX["source"] else "other", row[2] if row[2] in queries.MIX["lang"] else "other",
                topic(row[1]))

    tokens = {}
    for row in rows:
        tokens[cell(row)] = tokens.get(cell(row), 0) + len(row[1].split())
    weight = {c: float(n) for c, n in tokens.items() if n}
    shares = list(queries.MIX.values())
    for _ in range(sweeps):
        for place, wanted in enumerate(shares):
            goal = {v: wanted.get(v, 0 if v != "other" else max(0.0, 1 - sum(wanted.values()))) for v in {c[place] for c in weight}}
            total = {v: sum(w for c, w in weight.items() if c[place] == v) for v in goal}
            weight = {c: w * goal[c[place]] / sum(goal.values()) / (total[c[place]] or 1) for c, w in weight.items()}
    scale = sum(tokens.values()) / sum(weight.values())
    out = []
    for row in rows:
        expected = weight.get(cell(row), 0) * scale / max(tokens[cell(row)], 1) if row[1].split() else 0
        drawn = int(hashlib.md5(f"7:{row[0]}".encode()).hexdigest()[:12], 16) / 2**48
        copies = int(expected) + (drawn < expected - int(expected))
        if copies:
            out.append((*row, copies))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    rows, bad, items = corpus(rng)
    folder = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))

    want = [r for r in rows if r[0] not in bad]
    docs = corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(rows, COLUMNS), folder)
    assert sorted(map(tuple, docs.collect())) == want
    want = brute_lines(want)
    component = {doc: least for doc, _, least in brute_components([r[:2] for r in want])}
    want = [r for r in want if component[r[0]] == r[0]]
    hit = brute_leaks([r[:2] for r in want], items)
    assert any(hit.values())
    want = [r for r in want if not hit[r[0]]]
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_mix(want))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeats, columns with other names, and tables without rows go through every stage."""
    folder = str(tmp_path)
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "src0", 0, "b"), (3, "some words of text here", "en", "src0", 23, None),
            (3, "some words of text here", "en", "src0", 23, None), (None, "a text without an id", "en", "src1", 20, "c")]
    extra = ["_kept", "_keep", "_label", "_spans", "_items", "_row", "_text", "_copies", "id", "part", "row", "dropped"]
    docs = spark.createDataFrame([(*r, *range(1, 12)) for r in rows], COLUMNS + ", _kept string, "
                                 + ", ".join(f"{n} int" for n in extra[1:]))
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, folder)
        assert done.columns == docs.columns + (["copies"] if name == "source_mixing" else [])
        assert done.count() >= 1 and {tuple(r) for r in done.select(*extra[1:]).collect()} == {tuple(range(1, 12))}
        assert stage(spark, docs.limit(0), folder).collect() == []
