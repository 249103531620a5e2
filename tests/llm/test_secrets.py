"""Secret scans against the patterns' definition, and the battery on random and ordinary tokens."""

from __future__ import annotations

import random
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import secrets

ALNUM = string.ascii_letters + string.digits


def brute(text):
    text, found = text or "", []
    words = "password passwd secret token apikey api_key".split()
    either = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)
    pattern = re.compile("(" + either + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found += [(m.start(), 0, m.end()) for m in pattern.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


PARTS = st.sampled_from(["password", "TOKEN", "api_key", "ApiKey", "ſecret", "secret", "=", ":", " ", "  ", "'", '"',
                         "AKIA", "AKIAAKIA" + "A1" * 9, "0123456789abcdef", "abcdefabcdefabcdef0", "x" * 12, "é", "-_", "\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans(text):
    assert secrets.base_spans(text) == brute(text)


def test_battery_tells_random_from_words():
    rng = random.Random(1)
    for letters, least in ((ALNUM + "+/", 40), (string.ascii_lowercase + string.digits, 64), ("0123456789ABCDEF", 32)):
        tested = [secrets.battery("".join(rng.choices(letters, k=least)) + "a1A"[:0]) for _ in range(200)]
        tested = [t for t in tested if t]
        assert sum(t[1] >= .001 for t in tested) > .97 * len(tested)
        assert sum(t[2] < .05 for t in tested) > .8 * len(tested)
    words = "the and of that with for this which from there been have their would people2 before".split()
    plain = [secrets.battery("_".join(rng.choices(words, k=7)) + "2") for _ in range(200)]
    assert sum(t[1] >= .001 and t[2] < .001 for t in plain) < 5


def test_finds_keys_and_keeps_base(spark):
    rng = random.Random(2)
    keys = ["".join(rng.choices(ALNUM + "+/", k=64)) for _ in range(30)]
    docs = [(i, f"some words before {key} and après") for i, key in enumerate(keys)]
    docs += [(100 + i, " ".join(rng.choice(["donaudampfschifffahrtsgesellschaft", "under_score_words_are_long_2", "words"])
                               for _ in range(50))) for i in range(60)]
    docs += [(200, None), (201, ""), (202, "token: " + keys[0]), (202, "token: " + keys[0]), (None, "deadbeef" * 3),
             (203, "word " * 60_000 + "AKIA" + "Q7" * 10)]
    frame = spark.createDataFrame([(*d, 1, "t") for d in docs], "doc_id long, text string, base int, tokens string")
    rows = secrets.secrets(frame).collect()
    got = sorted(((r["id"], tuple(map(tuple, r["base"]))) for r in rows), key=repr)
    assert got == sorted(((d, tuple(brute(t))) for d, t in docs), key=repr)
    spans = {r["id"]: [tuple(s) for s in r["found"]] for r in rows}
    hit = [i for i, key in enumerate(keys) if (18, 3, 18 + len(key)) in spans[i]]
    assert len(hit) >= 27 and not any(spans[100 + i] for i in range(60))
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["found"])) for r in rows)
    assert secrets.secrets(frame.limit(0)).collect() == []
