"""Personal data against the patterns' definition, and contexts that find what the patterns do not know."""

from __future__ import annotations

import random
import re

from wardline.llm import pii
from wardline.llm.common import Scratch


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    text, found = text or "", []
    found += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


PARTS = ["a", "B.c", "_d%", "@", "@", "x-y", ".", ".com", "mail", " ", "\n", "1", "25", "255", "256", "007", "0000",
         "4539578763621486", "4539 5787-6362 1486", "+", "+1 ", "(017) ", "555-7713", "é", "😀", "-", "--", "12"]


def test_base_spans(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(25))) for _ in range(2500)]
    texts += [None, "", "1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "1" * 50_000, "a" * 50_000 + "@", "1 " * 30_000 + "@",
              "a@b" + ".c" * 30_000, "+" + "1(" * 30_000, "1.2.3.4 " * 5_000, "x@y.z\n" * 3_000, "." * 20_000 + "@1"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "a@b.cd")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, base string")
    got = sorted(((r["id"], [tuple(s) for s in r["base"]]) for r in pii.personal_data(docs).collect()), key=repr)
    assert got == sorted(((d, brute(t)) for d, t in rows), key=repr)
    assert pii.personal_data(docs.limit(0)).collect() == []


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"Please write to customer contact user{i}@mail.example.org soon" for i in range(12)]
    texts += ["please write to Customer Contact: KX-99417-B, thanks", "The year ended 20240101 and so on"]
    texts += [f"it was seen {n} times" for n in range(10_000, 10_020)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["id"]: [tuple(s) for s in r["found"]] for r in pii.personal_data(docs).collect()}
    at = texts[12].index("KX")
    assert found[12] == [(at, 4, at + len("KX-99417-B"))]
    assert all(found[i] == brute(texts[i]) for i in range(len(texts)) if i != 12)


def test_found_identifiers_induce_contexts(spark):
    """Identifiers found after one context make another trusted, before which no pattern ever matches."""
    ids = [f"KX-{n}417-B" for n in range(60, 66)]
    texts = [f"please write to customer contact user{i}@mail.example.org soon" for i in range(20)]
    texts += [f"please write to customer contact {x} soon" for x in ids]
    texts += [f"his badge number {x} was read" for x in ids] + ["her badge number QZ-88123-A was read"]
    texts += ["the part number QZ-55555-C is out"] + [f"the year number {n} began" for n in range(1900, 1920)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["id"]: [tuple(s) for s in r["found"]] for r in pii.personal_data(docs).collect()}
    for i in range(20, 33):
        value = next(w for w in texts[i].split() if w[2:3] == "-")
        at = texts[i].index(value)
        assert found[i] == [(at, 4, at + len(value))]
    assert all(found[i] == [] for i in range(33, len(texts)))
    rows = docs.select("doc_id", "text").withColumnRenamed("doc_id", "id").selectExpr("id as row", "id", "text")
    known = pii.base_and_tokens(pii.pattern_spans(rows))
    contexts = [{r["left"] for r in pii.trusted_contexts(known, Scratch(spark, "generations"), generations=g).collect()}
                for g in (1, 2, 4)]
    assert contexts[0] == {"customer contact"} and contexts[1] == contexts[2] == {"customer contact", "badge number"}


def test_no_python_on_the_main_path(spark, data):
    plan = pii.personal_data(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
