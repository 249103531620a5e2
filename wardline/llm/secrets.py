"""Secret scans: patterns, and a battery of randomness tests with length-aware false-discovery control.

Three patterns give the base spans. Every other long token is tested against chance: its encoding is
inferred, and character counts, runs and serial correlation are compared with those of uniformly random
symbols. Tokens that look random, and whose character counts ordinary text of that length would hardly
give, are discoveries. The threshold is set over the whole corpus per encoding and length class.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, over_batches

KINDS = ("assign", "access", "hex", "random")  # in the order in which they are listed

# fixed patterns of the base spans, and the length a match needs
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so the length may stand in the pattern
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")  # what the battery looks at

# Encodings from the narrowest: name, alphabet, and how far ordinary text is from uniform over it
# (the alphabet's size times the sum of squared letter shares of English, less 1).
ENCODINGS = (
    ("hex", "0123456789abcdef", 3.17),
    ("HEX", "0123456789ABCDEF", 3.17),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.10),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz", 1.36),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.06),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.19),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 3.19),
)
CODES = [(name, {c: i for i, c in enumerate(letters)}, gap) for name, letters, gap in ENCODINGS]

LENGTHS = (24, 32, 48, 96, 192)  # bounds of the length classes
MIN_RANDOM = 0.001               # least combined p-value of the battery for a token to look random
FALSE_SHARE = 0.01               # share of false discoveries allowed per class
BINS = 400                       # tenths of a decade in which p-values are counted


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three patterns, leftmost and not overlapping within a kind."""
    spans = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _upper_chi2(x: float, df: float, shift: float = 0.0) -> float:
    """Upper tail of a (noncentral) chi-squared variable, by a cube-root normal approximation."""
    a, b = df + shift, shift / (df + shift)
    spread = 2 * (1 + b) / (9 * a)
    return _upper_normal(((x / a) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def battery(token: str) -> tuple[int, float, float] | None:
    """(encoding, p of the battery if random, p of such even counts if ordinary); None without an encoding.

    The narrowest alphabet that holds all characters is the encoding; padding at the end is set aside. A
    token needs a digit and a letter, so that words and numbers are not tested. Uniformity is a chi-squared
    test, runs above and below the alphabet's middle and the correlation of neighbours are normal tests;
    Fisher's method combines the three.
    """
    token = token.rstrip("=")
    if not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token):
        return None
    for number, (_, code, gap) in enumerate(CODES):
        if all(c in code for c in token):
            break
    else:
        return None
    n, k = len(token), len(code)
    symbols = np.fromiter((code[c] for c in token), np.int64, n)
    counts = np.bincount(symbols, minlength=k)
    even = float((counts.astype(np.float64) ** 2).sum() * k / n - n)
    high = symbols >= k / 2
    ones, zeros = int(high.sum()), int(n - high.sum())
    if not ones or not zeros:
        return number, 0.0, 1.0
    runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 2 * ones * zeros / n + 1
    spread = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    centred = symbols - symbols.mean()
    serial = float((centred[1:] * centred[:-1]).sum() / (centred ** 2).sum()) + 1 / n
    tails = (_upper_chi2(even, k - 1), 2 * _upper_normal(abs(runs - mean) / math.sqrt(spread)),
             2 * _upper_normal(abs(serial) * math.sqrt(n)))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in tails)
    random = math.exp(-fisher / 2) * (1 + fisher / 2 + (fisher / 2) ** 2 / 2)  # chi-squared with six degrees
    return number, random, 1 - _upper_chi2(even, k - 1, n * gap)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Tokens that overlap no base span and look random, with their class and binned p-value."""
    found, taken = [], sorted((start, end) for start, _, end in spans)
    for m in TOKEN.finditer(text):
        while taken and taken[0][1] <= m.start():
            taken.pop(0)
        if taken and taken[0][0] < m.end():
            continue
        tested = battery(m[0])
        if tested:
            number, random, ordinary = tested
            size = sum(m.end() - m.start() >= bound for bound in LENGTHS)
            found.append({"start": m.start(), "end": m.end(), "stratum": number * 10 + size,
                          "bin": min(BINS, int(-10 * math.log10(max(ordinary, 1e-300)))) if random >= MIN_RANDOM else -1})
    return found


def thresholds(tested: DataFrame, false_share: float = FALSE_SHARE) -> dict[int, int]:
    """For each class the least bin that is a discovery (Benjamini and Hochberg over all its tokens).

    Tokens are counted per class and bin of p, a table whose size does not depend on the corpus. Tokens
    that do not look random count among the tests, but are never discovered. A bin counts with the largest
    p-value it can hold.
    """
    rows = (tested.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin")
            .agg(F.count(F.lit(1)).alias("n")).collect())
    least = {}
    for stratum in {r["stratum"] for r in rows}:
        own = sorted(((r["bin"], r["n"]) for r in rows if r["stratum"] == stratum), reverse=True)
        tests, seen = sum(n for _, n in own), 0
        for place, n in own:
            seen += n
            if place >= 0 and 10 ** (-place / 10) <= false_share * seen / tests:
                least[stratum] = place
    return least


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            false_share: float = FALSE_SHARE) -> DataFrame:
    """(id, base, found): base spans and discovered spans as structs (start, kind, end), one row per row.

    Offsets count code points, ends are exclusive; ``kind`` is a place in KINDS. Base spans are sorted by
    start and kind, ``found`` adds the discoveries, none of which overlaps a base span. A null text is
    empty; long texts are scanned whole; equal rows give equal rows; an empty table stays empty; other
    columns are ignored.
    """
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, tokens = [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text or "")
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            tokens.append(candidates(text or "", spans))
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        token = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "end", "stratum", "bin")]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(tokens, token)],
                                          names=["id", "base", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tested = Scratch(docs.sparkSession, "secrets").keep(over_batches(
        rows, scan, "id long, base array<struct<start:int,kind:int,end:int>>, "
                    "tokens array<struct<start:int,end:int,stratum:int,bin:int>>"))
    least = thresholds(tested, false_share)
    limits = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair]) if least else None
    passed = F.filter("tokens", lambda t: (t["bin"] >= 0) & (t["bin"] >= limits[t["stratum"]])) if least else F.filter(
        "tokens", lambda t: F.lit(False))
    found = F.transform(passed, lambda t: F.struct(
        t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return tested.select("id", "base", F.array_sort(F.concat("base", found)).alias("found"))

