"""Benchmark decontamination: spaced-seed hashes, joined and verified by substitution-tolerant overlaps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import mixed, over_batches, split_words, word_hashes

# A 1 stands for a token that is hashed, a 0 for one that may differ. Of n >= 12 tokens at most n / 5 differ, which
# leaves a run of four equal ones, but for 15 tokens in four runs of three: there two runs fit the second mask.
MASKS = ("1111", "1110111")

MIN_WORDS = 12            # tokens an overlap needs, or the whole item where it is shorter
MIN_SIMILARITY = 0.8      # share of equal tokens in an overlap
PIECE_WORDS = 4_096       # longer items are compared in overlapping pieces
BLOCK_WORDS = 2_000_000   # tokens of the benchmark that every task gets at once
HITS = 20_000             # seed hits whose surroundings are compared at once
OFTEN = 32                # hits of one diagonal among these from which all of it is compared

SPANS = "array<struct<item:bigint,start:int,words:int,equal:int>>"


def seed_hashes(words: np.ndarray, starts: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a mask over texts laid end to end; a mask never reaches into the next text."""
    at = [i for i, bit in enumerate(mask) if bit == "1"]
    count = len(words) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed = np.full(count, len(mask), np.uint64)
    for i in at:
        hashed = mixed(hashed) + words[i:i + count]
    inside = np.ones(count, bool)
    for start in starts[1:-1]:
        inside[max(0, start - len(mask) + 1):start] = False
    places = np.flatnonzero(inside)
    return places, mixed(hashed[places])


class Block:
    """Part of the benchmark: its tokens, and its seeds sorted by hash."""

    def __init__(self, items: list[tuple[int, int, str]], masks: tuple[str, ...], min_words: int):
        values, starts = split_words(pa.array([text for _, _, text in items], pa.string()))
        self.words, self.starts = word_hashes(values), starts
        self.names = np.array([item for item, _, _ in items], np.int64)
        self.needed = np.minimum(min_words, np.array([words for _, words, _ in items], np.int64))
        self.masks, self.min_words, self.seeds = masks, min_words, []
        for mask in masks:
            places, hashes = seed_hashes(self.words, starts, mask)
            order = np.argsort(hashes, kind="stable")
            self.seeds.append((hashes[order], places[order]))
        self.short = {}  # shorter items are looked up whole: they may be left without a run of four
        for i in range(len(items)):
            own = self.words[starts[i]:starts[i + 1]]
            if 0 < len(own) < max(min_words, *map(len, masks)):
                self.short.setdefault(len(own), {}).setdefault(int(own[0]), []).append(i)

    def diagonals(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (text, piece, shift) rows where a seed of a text equals a seed of a piece."""
        found = []
        for mask, (hashes, at) in zip(self.masks, self.seeds):
            if not len(hashes):
                continue
            places, own = seed_hashes(words, starts, mask)
            low = np.searchsorted(hashes, own)
            hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == own)
            high = np.searchsorted(hashes, own[hit], side="right")
            ends = np.cumsum(high - low[hit])  # a hit for every place of the seed; a part of them at a time
            tried = np.zeros(0, np.int64)
            for n in range(0, int(ends[-1]) if len(ends) else 0, HITS):
                nth = np.arange(n, min(n + HITS, int(ends[-1])))
                of = np.searchsorted(ends, nth, "right")
                place, other = places[hit[of]], at[high[of] - (ends[of] - nth)]
                text = np.searchsorted(starts, place, "right") - 1
                piece = np.searchsorted(self.starts, other, "right") - 1
                shift = place - other
                line = ((shift + len(self.words)) * len(self.names) + piece) * (len(starts) - 1) + text
                fresh = ~np.isin(line, tried)
                place, other, line = place[fresh], other[fresh], line[fresh]
                rows = np.stack([text[fresh], piece[fresh], shift[fresh]], axis=1)
                _, own_line, hits = np.unique(line, return_inverse=True, return_counts=True)
                often = hits >= OFTEN  # cheaper to compare the whole diagonal, once
                good = often[own_line]
                rest = ~good
                good[rest] = self.dense(place[rest], other[rest], words, starts)
                found.append(rows[good])
                tried = np.union1d(tried, line[good])
        for length, firsts in self.short.items():
            known = np.fromiter(firsts, np.uint64, len(firsts))
            for place in np.flatnonzero(np.isin(words, known)):
                for piece in firsts[int(words[place])]:
                    text = int(np.searchsorted(starts, place, "right")) - 1
                    found.append(np.array([[text, piece, place - self.starts[piece]]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def dense(self, place: np.ndarray, other: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hits that lie in or beside a span of ``min_words`` to twice as many tokens with enough equal ones.

        An overlap of any length has such a part, and the part has a seed; other hits need no alignment.
        """
        reach = 2 * self.min_words
        text, piece = np.searchsorted(starts, place, "right") - 1, np.searchsorted(self.starts, other, "right") - 1
        before = np.minimum(place - starts[text], other - self.starts[piece])
        after = np.minimum(starts[text + 1] - place, self.starts[piece + 1] - other)
        steps = np.arange(-reach, reach)
        inside = (steps >= -before[:, None]) & (steps < after[:, None])
        equal = inside & (words[np.clip(place[:, None] + steps, 0, len(words) - 1)]
                          == self.words[np.clip(other[:, None] + steps, 0, len(self.words) - 1)])
        total = np.zeros((len(place), 2 * reach + 1), np.int16)
        np.cumsum(equal, axis=1, out=total[:, 1:])
        good = np.zeros(len(place), bool)
        for size in range(self.min_words, reach):
            good |= (total[:, size:] - total[:, :-size]).max(axis=1) >= MIN_SIMILARITY * size - 1e-6
        return good

    def overlaps(self, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, equal words) of the best overlap on each diagonal that passes."""
        for text, piece, shift in self.diagonals(words, starts):
            a = max(starts[text], self.starts[piece] + shift)
            b = min(starts[text + 1], self.starts[piece + 1] + shift)
            equal = words[a:b] == self.words[a - shift:b - shift]
            span = best_span(equal, MIN_SIMILARITY)
            if span and span[1] - span[0] >= self.needed[piece]:
                yield (int(text), int(self.names[piece]), int(a - starts[text]) + span[0], span[1] - span[0],
                       int(equal[span[0]:span[1]].sum()))


def best_span(equal: np.ndarray, similarity: float) -> tuple[int, int] | None:
    """The longest span that begins and ends with equal tokens and has at least this share of them."""
    score = np.concatenate([[0.0], np.cumsum(equal - similarity + 1e-9)])
    edge = np.concatenate([[False], equal, [False]]).astype(bool)
    least = np.minimum.accumulate(np.where(edge[1:], score, np.inf))               # of beginnings, never rises
    most = np.maximum.accumulate(np.where(edge[:-1], score, -np.inf)[::-1])[::-1]  # of ends, from here on
    # the last end that is high enough for each beginning
    last = len(most) - 1 - np.searchsorted(most[::-1], least, "left")
    length = np.where(np.isfinite(least), last - np.arange(len(least)), 0)
    i = int(length.argmax())
    return (i, i + int(length[i])) if length[i] > 0 else None


def pieces(benchmark: DataFrame, id_col: str, text_col: str, piece_words: int, overlap: int) -> DataFrame:
    """(item, words, text): items in pieces; each shares its first ``overlap`` words with the one before."""
    words = F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[ \t\n\x0B\f\r]+"),
                     lambda w: w != "")
    step = piece_words - overlap
    cut = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), words.alias("w"))
    cut = cut.where(F.size("w") > 0).select("item", F.size("w").alias("words"), "w", F.explode(F.sequence(
        F.lit(0), F.greatest(F.lit(0), F.size("w") - overlap - 1), F.lit(step))).alias("at"))
    return cut.select("item", "words", F.array_join(F.expr(f"slice(w, at + 1, {piece_words})"), " ").alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", carry: list[str] | None = None, min_words: int = MIN_WORDS,
          masks: tuple[str, ...] = MASKS, block_words: int = BLOCK_WORDS,
          piece_words: int = PIECE_WORDS) -> DataFrame:
    """The rows of ``docs``, or their columns ``carry``, with what each text shares with benchmark items.

    ``_items`` lists the item ids in order, ``_spans`` the overlaps as (item, start, words, equal) in words.
    Tokens are runs of characters other than ASCII white space, A-Z in lower case. Masks hash chosen places
    of a window; equal hashes of a document and an item give a diagonal, along which the longest span with
    at least 80 % equal tokens is taken, reported from ``min_words`` words on (an item of fewer words: whole).
    From 12 words on the masks leave out no such span.
    The benchmark is measured and sent in blocks of a bounded size; documents are scanned once per block, and
    nothing of them is shuffled. Null or empty texts share nothing, items without an id or text are left out;
    rows that repeat stay rows; without items every list is empty; other columns pass through, but that columns of
    the caller named ``_items`` or ``_spans`` give way to those.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("_items", "_spans")]
    cut = pieces(benchmark, item_id, item_text, piece_words, max(max(map(len, masks)), min_words) * 10)
    total = cut.agg(F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0))).first()[0]
    count = max(1, math.ceil(total / block_words))
    # the caller's columns travel in one struct, so that their names meet no name of this operator
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0))
    rows = docs.select(carried.alias("_row"), F.col(text_col).cast("string").alias("_text"),
                       F.array().cast(SPANS).alias("_spans"))
    for n in range(count):
        own = cut.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == n).collect()
        block = Block([(r["item"], r["words"], r["text"]) for r in own], masks, min_words)
        rows = _scanned(rows, docs.sparkSession.sparkContext.broadcast(block), last=n == count - 1)
    items = F.array_sort(F.array_distinct(F.transform("_spans", lambda s: s["item"])))
    found = rows.select("_row", F.array_sort("_spans").alias("_spans"), items.alias("_items"))
    return found.select(*[F.col("_row")[c].alias(c) for c in carry], "_spans", "_items")


def _scanned(rows: DataFrame, block: Broadcast, last: bool) -> DataFrame:
    """The rows with a block's overlaps added to ``_spans``; ``_text`` goes with the last block."""
    kind = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int32()), ("words", pa.int32()),
                               ("equal", pa.int32())]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        *carried, texts, before = batch.columns
        values, starts = split_words(texts)
        spans = before.to_pylist()
        for text, *span in block.value.overlaps(word_hashes(values), starts):
            spans[text].append(dict(zip(("item", "start", "words", "equal"), span)))
        names = batch.schema.names
        return pa.RecordBatch.from_arrays([*carried, *([] if last else [texts]), pa.array(spans, kind)],
                                          names=[n for n in names if not (last and n == "_text")])

    schema = rows.drop("_text").schema if last else rows.schema
    return over_batches(rows, scan, schema)
