"""SimHash near-duplicates: one-wildcard segment variants, joined by equality and verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, components, over_batches

MAX_BITS = 2    # bits in which linked fingerprints may differ
SMALL = 64      # members of a variant group that are compared pair by pair
BLOCK = 8_192   # shingles whose bits are counted at once


def fingerprint_of(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed number.

    Fewer words than ``size`` make one shingle; a null text or one without words gives zero.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    size = min(size, len(words))
    digest = xxhash.xxh64_digest
    ones, total = np.zeros(64, np.int64), len(words) - size + 1
    spans = list(zip(starts, ends[size - 1:].tolist()))
    for at in range(0, total, BLOCK):
        raw = b"".join([digest(joined[i:j], 42) for i, j in spans[at:at + BLOCK]])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, part, fp) for every row; ``part`` tells apart rows that repeat an id with another text."""
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([fingerprint_of(t, size) for t in batch.column(2).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["id", "part", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), part_of(text).alias("part"), text.alias("text"))
    return over_batches(rows, scan, "id long, part long, fp long")


def part_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _variants(fp: Column) -> Column:
    """Keys of the two 32-bit halves with one bit wild: half and bit in the upper part, the rest below."""
    halves = (F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.array(*[F.lit((half << 37) | (bit << 32)).bitwiseOR(value.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))))
                     for half, value in enumerate(halves) for bit in range(32)])


def links(distinct: DataFrame, scratch: Scratch, small: int = SMALL) -> DataFrame:
    """Pairs (a, b) of fingerprints that join all fingerprints within two bits of each other.

    Of two fingerprints that differ in at most two bits, one 32-bit half differs in at most one: both
    stand in the group of that half with this bit wild. Groups of two are their least and greatest
    member; groups of up to ``small`` are compared pair by pair and verified. Members of larger groups
    are indexed once more, with every two bits wild: at most four fingerprints share such a key and any
    two of them are linked, so that a group of any size takes a fixed number of rows per member.
    """
    # the table of fingerprints is small and its variants are not: deal it out before they are made
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.repartition(parts, "fp").select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    groups = scratch.keep(keyed.groupBy("key")
                          .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                          .where("n > 1"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    twos = groups.where("n = 2").select("a", "b").where(close)

    several = keyed.join(groups.where(f"n between 3 and {small}").select("key"), "key")
    members = several.groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    paired = F.flatten(F.transform("m", lambda x, i: F.transform(
        F.filter(F.slice(F.col("m"), i + 2, F.lit(small)), lambda y: F.bit_count(x.bitwiseXOR(y)) <= MAX_BITS),
        lambda y: F.struct(x.alias("a"), y.alias("b")))))
    fews = members.select(F.inline(paired))

    crowded = keyed.join(groups.where(f"n > {small}").select("key"), "key").select("fp").distinct()
    wild = (crowded.select("fp", F.explode(F.sequence(F.lit(1), F.lit(63))).alias("i"))
            .select("fp", "i", F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("j"))
            .select("fp", F.expr("shiftleft(1L, i) | shiftleft(1L, j)").alias("mask")))
    cliques = (wild.groupBy("mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
               .agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1))
    many = cliques.select(F.inline(F.transform(F.slice("m", 2, 3), lambda y: F.struct(
        F.col("m")[0].alias("a"), y.alias("b")))))
    return twos.union(fews).union(many).distinct()


def labelled_prints(distinct: DataFrame, scratch: Scratch, small: int = SMALL) -> DataFrame:
    """The distinct fingerprints, ``fp`` and other columns, with ``label``: the least fingerprint reachable by links."""
    joined = components(links(distinct.select("fp"), scratch, small), scratch)
    return scratch.keep(distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
                        .withColumn("label", F.coalesce("label", "fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
                    small: int = SMALL) -> DataFrame:
    """One row per input row: (id, fp, component), the component being the least id reachable by links.

    Fingerprints link when at most two of their bits differ; equal ones are one node, so copies cost
    nothing. Texts without words share fingerprint zero and link like any other. Rows that repeat an id
    come back as often as they stand there; a null id takes part, but is never a component's name (a
    component of null ids alone has none). An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    found = scratch.keep(fingerprints(docs, id_col, text_col, size))
    distinct = scratch.keep(found.groupBy("fp").agg(F.min("id").alias("least")))
    labelled = labelled_prints(distinct, scratch, small)
    least = labelled.groupBy("label").agg(F.min("least").alias("component"))
    named = scratch.keep(labelled.join(least, "label").select("fp", "component"))
    return found.join(named, "fp").select("id", "fp", "component")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
                        small: int = SMALL) -> DataFrame:
    """The rows of one document of each group of linked fingerprints: the one with the smallest id.

    A row stands for its id and its text. Of a group's rows with the smallest id and different texts those of one text
    stay (the one with the least hash), and of rows that repeat both one stays. A row that repeats an id with the text
    of another group is judged in that group. Rows without an id cannot be named and stay; they may link others. An
    empty table stays empty; other columns pass through, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "simhash-copies")
    found = scratch.keep(fingerprints(docs, id_col, text_col, size))
    distinct = scratch.keep(found.groupBy("fp").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "part"))).alias("least")))
    labelled = labelled_prints(distinct, scratch, small)
    first = scratch.keep(labelled.groupBy("label").agg(F.min("least").alias("least")).where("least is not null")
                         .select("least.id", "least.part"))
    # the caller's columns travel in one struct, so that their names meet no name of this operator
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(id_col).cast("long").alias("id"), part_of(F.col(text_col).cast("string")).alias("part"))
    kept = rows.where("id is not null").join(first, ["id", "part"], "left_semi").dropDuplicates(["id", "part"])
    return kept.union(rows.where("id is null").select(*kept.columns)).select("row.*")
