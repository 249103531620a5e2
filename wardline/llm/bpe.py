"""Byte-level BPE: recursive DuckDB queries in every task contract token rows, ordered aggregation decodes them.

Spark deals the texts out; a task looks only at the pre-tokens it has not met yet. Their token-position rows
join the merge table, and every step of the recursion contracts each word's leftmost pair of least rank.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import over_batches

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")  # read by the driver
PATTERN = public_tokenizers.PATTERN

KNOWN_WORDS = 400_000   # pre-tokens a task remembers; beyond them it starts anew
LONG_WORD = 64          # bytes beyond which a pre-token is contracted by the other query and not remembered
QUERY_ROWS = 250_000    # token rows one query starts from, unless a single pre-token has more
STATE_ROWS = 4_000_000  # token rows one query may go through, about; its last state starts the next query

# One step: token rows join the pair that begins at them, and each word contracts its leftmost pair of least rank.
# ``i`` grows over all words, so one order serves all. What no longer has a pair stays behind at its last step.
ENCODE = """
WITH RECURSIVE state(w, i, t, step) AS (
    SELECT w, i, t, 0 FROM start
    UNION ALL
    (WITH placed AS MATERIALIZED (
        SELECT w, i, t, step, CASE WHEN lead(w) OVER o = w THEN lead(t) OVER o END AS next, lag(i) OVER o AS prev
        FROM state WHERE step < $steps WINDOW o AS (ORDER BY i)),
    best AS (SELECT w, min((id::BIGINT << 32) | i) AS pair
             FROM placed JOIN merges m ON m.a = t AND m.b = next GROUP BY w)
    SELECT w, i, CASE WHEN i = pair & 4294967295 THEN pair >> 32 ELSE t END::INT, step + 1
    FROM placed JOIN best USING (w)
    WHERE prev IS DISTINCT FROM pair & 4294967295))
SELECT w, i, t, step FROM state JOIN (SELECT w, max(step) AS step FROM state GROUP BY w) USING (w, step)
ORDER BY i"""

# The same for long words, with one step for all occurrences of the pair, the leftmost first. That gives the same
# tokens unless the new token may belong to a pair of still lower rank: such a pair goes alone.
ENCODE_LONG = """
WITH RECURSIVE state(w, i, t, step) AS (
    SELECT w, i, t, 0 FROM start
    UNION ALL
    (WITH placed AS MATERIALIZED (
        SELECT w, i, t, step, CASE WHEN lead(w) OVER o = w THEN lead(t) OVER o END AS next, lag(i) OVER o AS prev,
               row_number() OVER o AS n
        FROM state WHERE step < $steps WINDOW o AS (ORDER BY i)),
    pairs AS MATERIALIZED (SELECT w, i, n, id, alone FROM placed JOIN merges m ON m.a = t AND m.b = next),
    best AS MATERIALIZED (SELECT w, min(id) AS id, min((id::BIGINT << 32) | i) & 4294967295 AS leftmost
                          FROM pairs GROUP BY w),
    hits AS (SELECT w, i, id, alone, leftmost, n - row_number() OVER (PARTITION BY w ORDER BY i) AS run
             FROM pairs JOIN best USING (w, id)),
    picks AS MATERIALIZED (
        SELECT w, i, id FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY i) AS place FROM hits)
        WHERE CASE WHEN alone THEN i = leftmost ELSE place % 2 = 1 END)
    SELECT w, i, coalesce(k.id, t), step + 1
    FROM placed JOIN best USING (w) LEFT JOIN picks k USING (w, i)
    WHERE prev IS NULL OR prev NOT IN (SELECT i FROM picks)))
SELECT w, i, t, step FROM state JOIN (SELECT w, max(step) AS step FROM state GROUP BY w) USING (w, step)
ORDER BY i"""

DECODE = """
SELECT row, string_agg(bytes, '' ORDER BY i) AS bytes, count(bytes) AS known
FROM given LEFT JOIN tokens USING (t) GROUP BY row"""


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by their rank, which is also their id."""

    tokens: dict[int, bytes]

    @staticmethod
    def read(path: str) -> Vocabulary:
        """A file with a base64 token and its rank in every line."""
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return Vocabulary({int(rank): base64.b64decode(token) for token, rank in pairs})

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {token: rank for rank, token in self.tokens.items()}

    @cached_property
    def merges(self) -> pa.Table:
        """(a, b, id, alone): every two tokens that together are a token. ``alone``: a token of lower rank
        begins or ends with the merged one, so that its occurrences must be contracted one at a time."""
        ranks = self.ranks
        alone, rows = set(), []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                alone.update(part for part in (a, b) if part is not None and part > rank)
                if a is not None and b is not None:
                    rows.append((a, b, rank))
        a, b, ids = (np.array(column, np.int32) for column in zip(*rows)) if rows else [np.zeros(0, np.int32)] * 3
        return pa.table({"a": a, "b": b, "id": ids, "alone": np.isin(ids, list(alone))})


class Coder:
    """One task's DuckDB, with the vocabulary's tables and the pre-tokens met so far."""

    def __init__(self, vocabulary: Vocabulary, known_words: int = KNOWN_WORDS, state_rows: int = STATE_ROWS):
        self.ranks, self.known_words, self.state_rows = vocabulary.ranks, known_words, state_rows
        self.known: dict[str, tuple[int, ...]] = {}
        self.single = np.array([self.ranks.get(bytes([byte]), -1) for byte in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB"})
        self.db.register("pairs", vocabulary.merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM pairs")
        # a byte travels as the character of its number, which text functions keep
        self.db.register("listed", pa.table({
            "t": pa.array(list(vocabulary.tokens), pa.int32()),
            "bytes": [token.decode("latin-1") for token in vocabulary.tokens.values()]}))
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM listed")

    def encode(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of different pre-tokens; a pre-token that is itself a token is that token."""
        found: dict[str, tuple[int, ...]] = {}
        for long in (False, True):
            parts, rows = [], 0
            for word in words:
                data = word.encode("utf-8")
                if (len(data) > LONG_WORD) != long:
                    continue
                rank = self.ranks.get(data)
                if rank is not None:
                    found[word] = (rank,)
                    continue
                if rows and rows + len(data) > QUERY_ROWS:
                    found.update(self._contracted(parts, long))
                    parts, rows = [], 0
                parts.append((word, data))
                rows += len(data)
            if parts:
                found.update(self._contracted(parts, long))
        return found

    def _contracted(self, parts: list[tuple[str, bytes]], long: bool) -> dict[str, tuple[int, ...]]:
        sizes = np.array([len(data) for _, data in parts])
        w = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        i = np.arange(len(w), dtype=np.int32)
        t = self.single[np.frombuffer(b"".join(data for _, data in parts), np.uint8)]
        if (t < 0).any():
            raise ValueError("the vocabulary lacks single bytes that a text has")
        found = {}
        while len(w):  # a query goes through a bounded number of steps; unsettled words go on from there
            steps = max(1, min(64, self.state_rows // len(w)))
            self.db.register("start", pa.table({"w": w, "i": i, "t": t}))
            state = self.db.execute(ENCODE_LONG if long else ENCODE, {"steps": steps}).fetchnumpy()
            w, i, t = (np.asarray(state[name]) for name in ("w", "i", "t"))
            settled = np.asarray(state["step"]) < steps
            starts = np.flatnonzero(np.diff(w, prepend=-1))
            for begin, end in zip(starts, np.append(starts[1:], len(w))):
                if settled[begin]:
                    found[parts[w[begin]][0]] = tuple(t[begin:end].tolist())
            w, i, t = w[~settled], i[~settled], t[~settled]
        return found

    def ids(self, texts: list[list[str]]) -> list[list[int]]:
        """The ids of texts given as their pre-tokens."""
        fresh = set(chain.from_iterable(texts)).difference(self.known)
        if len(self.known) + len(fresh) > self.known_words:
            self.known, fresh = {}, fresh.union(chain.from_iterable(texts))
        self.known.update(self.encode(list(fresh)))
        known = self.known
        coded = [list(chain.from_iterable(map(known.__getitem__, words))) for words in texts]
        for word in fresh:
            if len(word) > LONG_WORD // 4 and len(word.encode("utf-8")) > LONG_WORD:
                del known[word]
        return coded

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[bytes | None]:
        """The bytes of lists of ids; None where an id is no token."""
        rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        self.db.register("given", pa.table({"row": rows, "i": np.arange(len(ids), dtype=np.int32), "t": ids}))
        found: list[bytes | None] = [b""] * (len(offsets) - 1)
        sizes = np.diff(offsets)
        for row, text, known in self.db.execute(DECODE).fetchall():
            found[row] = text.encode("latin-1") if known == sizes[row] else None
        return found


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            vocabulary: str | Vocabulary = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, ids), one row per input row: the ids of its text, as ordinary text without special tokens.

    Every match of ``pattern`` is encoded by itself. A null or empty text has no ids; texts of any length are
    encoded whole; equal rows give equal rows; an empty table stays empty; other columns are ignored, a null id
    stays null. Nothing is shuffled. The vocabulary, which has a fixed size, is sent to every task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    coders: list[Coder] = []  # one per task
    split = regex.compile(pattern)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not coders:
            coders.append(Coder(shared.value))
        texts = [split.findall(text or "") for text in batch.column(1).to_pylist()]
        lists = coders[0].ids(texts)
        offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
        values = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return over_batches(rows, encode, "id long, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str | Vocabulary = VOCABULARY) -> DataFrame:
    """The rows (id, ids) with ``bytes``: what the ids stand for, in order.

    No ids, or null for them, give no bytes; a row with a null id or one that the vocabulary lacks gives null.
    The bytes of whole texts are UTF-8; those of cut lists need not be.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    coders: list[Coder] = []

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not coders:
            coders.append(Coder(shared.value))
        lists = batch.column(1).to_pylist() if batch.column(1).null_count else None
        if lists is None:
            own = batch.column(1)
            offsets = np.asarray(own.offsets)
            ids = own.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(-1).to_numpy()
            offsets = offsets - offsets[0]
        else:
            offsets = np.cumsum([0, *(len(x or ()) for x in lists)])
            ids = np.array([-1 if x is None else x for own in lists for x in own or ()], np.int32)
        found = coders[0].decode(offsets, ids)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())],
                                          names=["id", "ids", "bytes"])

    return over_batches(rows.select("id", "ids"), decode, "id long, ids array<int>, bytes binary")


def _vocabulary(given: str | Vocabulary) -> Vocabulary:
    vocabulary = Vocabulary.read(given) if isinstance(given, str) else given
    vocabulary.merges  # built once, by the driver
    return vocabulary
