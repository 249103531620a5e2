"""Helpers shared by the operators of this subpackage: scratch tables, words of Arrow batches, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import scratch_dir, ship_package

SPACE = " \t\n\x0b\x0c\r"  # the characters that part words

MAX_BATCH_ROWS = 1_000       # rows a Python worker works on at once,
MAX_BATCH_BYTES = 4_000_000  # and bytes, unless a single row has more


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs only the tasks it was running.

    A written table is computed once, cuts the lineage and has a known size, by which Spark decides on
    its own whether to broadcast it. ``drop`` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, scratch_dir(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(kept.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def over_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function to the Arrow batches of a table, a bounded part of a batch at a time."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size = 0, max(1, batch.nbytes)
            while at < batch.num_rows:
                rows = min(MAX_BATCH_ROWS, batch.num_rows - at)
                if size > MAX_BATCH_BYTES:
                    while rows > 1 and batch.slice(at, rows).nbytes > MAX_BATCH_BYTES:
                        rows = (rows + 1) // 2
                yield function(batch.slice(at, rows))
                at += rows

    return df.mapInArrow(run, schema)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words of a batch, one after the other, and where each text's words begin (one entry more).

    A word is a run of characters other than ASCII white space; ``lower`` turns A-Z to a-z. A null
    text is empty.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = texts.take(pa.array(np.arange(len(texts))))  # a copy: lowering a slice gives wrong offsets
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    values = lists.values
    there = np.asarray(pc.not_equal(values, ""))
    before = np.concatenate([[0], np.cumsum(there)])
    return values.filter(pa.array(there)), before[offsets]


def word_hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; every distinct word of the batch is hashed once."""
    coded = values.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(word) for word in coded.dictionary.to_pylist()),
                         dtype=np.uint64, count=len(coded.dictionary))
    return hashes[np.asarray(coded.indices)] if len(values) else np.zeros(0, np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a multiply-and-shift finalizer)."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, other letters as they are. A text of ASCII alone takes Spark's fast path."""
    return (F.when(F.octet_length(text) == F.length(text), F.lower(text))
            .otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def joined_spans(spans: str, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of an array of (start, kind, end), comma-joined; the kind is a place in ``kinds``."""
    names = F.array(*[F.lit(kind) for kind in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """(node, label) of every node that has an edge; the label is the smallest node reachable.

    ``edges`` has the columns ``a`` and ``b``. Each round takes the smallest label among the neighbours
    and then the label of that label, so that chains shorten by more than half. Labels lie in the shared
    folder between rounds; nothing goes to the driver but the number of labels that changed. Joins read
    written tables on both sides, which lets adaptive execution split a label that many nodes share.
    """
    both = scratch.keep(edges.where("a <> b").select("a", "b")
                        .union(edges.where("a <> b").select("b", "a")).distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("node"))
                          .agg(F.least(F.min("b"), F.min("a")).alias("label")))
    for _ in range(max_rounds):
        seen = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        nearer = scratch.keep(labels.join(seen, "node")
                              .select("node", F.least("label", "near").alias("label"),
                                      (F.col("near") < F.col("label")).alias("moved")))
        roots = nearer.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = scratch.keep(nearer.join(roots, "label").select("node", F.col("root").alias("label"), "moved"))
        moved = jumped.where("moved").limit(1).count()
        scratch.drop(labels)
        scratch.drop(nearer)
        labels = jumped
        if not moved:
            return labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
