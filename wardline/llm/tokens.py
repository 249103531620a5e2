"""Token counts: a trie of distinct words whose nodes hold unigram forward scores, shared by prefixes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import over_batches, split_words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"  # a public vocabulary, read by the driver
START = "▁"      # stands before every word
MAX_NODES = 300_000   # trie nodes a task keeps; beyond them it starts a new trie
LONG_WORD = 500       # longer words are scored without being stored


def unigram_scores(path: str = VOCABULARY) -> dict[str, int]:
    """Pieces with their log-probabilities in millionths, by Zipf's law from their rank in the file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = [i for i in range(model.get_piece_size()) if not (
        model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked.sort(key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -round(1e6 * math.log(rank + 2)) for rank, i in enumerate(ranked)}


class Trie:
    """Distinct words; each node has the best score and token count of the word that ends there.

    The forward score of a prefix is the best over its last piece; of equal scores the fewer tokens win. A
    node is computed when a word first reaches it and serves all words with that prefix. A character
    without a piece costs one token per UTF-8 byte.
    """

    def __init__(self, scores: dict[str, int], max_nodes: int = MAX_NODES):
        self.backward: dict = {}  # pieces spelled from their last character; the score lies under ""
        for piece, score in scores.items():
            node = self.backward
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[""] = score
        self.unknown = min(scores.values(), default=0) - 10_000_000
        self.max_nodes = max_nodes
        self.computed = 0
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.score, self.tokens = [0], [0]

    def _best(self, word: str, end: int, score, tokens) -> tuple[int, int]:
        """Best score and count of ``word[:end]`` from those of its prefixes."""
        self.computed += 1
        best, count, node = None, 0, self.backward
        for begin in range(end - 1, -1, -1):
            node = node.get(word[begin])
            if node is None:
                break
            piece = node.get("")
            if piece is not None:
                total, n = score(begin) + piece, tokens(begin) + 1
                if best is None or total > best or (total == best and n < count):
                    best, count = total, n
        if "" not in self.backward.get(word[end - 1], ()):
            total = score(end - 1) + self.unknown
            n = tokens(end - 1) + len(word[end - 1].encode("utf-8", "replace"))
            if best is None or total > best or (total == best and n < count):
                best, count = total, n
        return best, count

    def count(self, word: str) -> int:
        """Tokens of a word."""
        if len(word) > LONG_WORD:
            return self._unstored(word)
        if len(self.score) > self.max_nodes:
            self.clear()
        node, path, children = 0, [0], self.children
        for end, char in enumerate(word, 1):
            key = (node << 21) | ord(char)
            node = children.get(key)
            if node is None:
                score, count = self._best(word, end, lambda i: self.score[path[i]], lambda i: self.tokens[path[i]])
                node = children[key] = len(self.score)
                self.score.append(score)
                self.tokens.append(count)
            path.append(node)
        return self.tokens[node]

    def _unstored(self, word: str) -> int:
        score, tokens = np.zeros(len(word) + 1, np.int64), np.zeros(len(word) + 1, np.int64)
        for end in range(1, len(word) + 1):
            score[end], tokens[end] = self._best(word, end, lambda i: int(score[i]), lambda i: int(tokens[i]))
        return int(tokens[-1])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | dict[str, int] = VOCABULARY, max_nodes: int = MAX_NODES) -> DataFrame:
    """(id, words, tokens), one row per input row.

    Words are runs of characters other than ASCII white space; each is segmented with the word-start mark
    before it, and every distinct word of a batch once. Nothing is shuffled: a word found in many tasks is
    scored in each, which costs less than bringing counts back to every occurrence. Null and empty texts
    have no words and no tokens; long texts and words are counted whole; equal rows give equal rows; an
    empty table stays empty; other columns are ignored. The vocabulary has a fixed size.
    """
    scores = unigram_scores(vocabulary) if isinstance(vocabulary, str) else vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    tries: list[Trie] = []  # one per Python worker, kept between batches of a task

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not tries:
            tries.append(Trie(shared.value, max_nodes))
        values, starts = split_words(batch.column(1), lower=False)
        coded = values.dictionary_encode()
        known = np.fromiter((tries[0].count(START + word) for word in coded.dictionary.to_pylist()),
                            np.int64, len(coded.dictionary))
        counts = known[np.asarray(coded.indices)] if len(values) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(counts)])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(starts)), pa.array(total[starts[1:]] - total[starts[:-1]])],
            names=["id", "words", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return over_batches(rows, scan, "id long, words long, tokens long")
