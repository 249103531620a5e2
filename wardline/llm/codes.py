"""Vector codes: vectors are cut into parts, each part is named by the nearest entry of its codebook.

The nearest entry is searched in a GNAT over the entries: split points with the ranges of distances from every
split point to every subtree, by which a query's own distances rule out whole subtrees. Entries and parts are
integers, so distances and ties are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, over_batches
from wardline.operators.joins import lookup_join
from wardline.session import ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 2**26        # components beyond it, either way, are taken for it: sums of squares stay exact
SPLITS, LEAF = 4, 4    # split points of a node, entries of a leaf


def root_below(square: np.ndarray) -> np.ndarray:
    """A number not above the root of an integer: the float root, moved down by more than its rounding."""
    return np.maximum(np.sqrt(square.astype(np.float64)) * (1 - 1e-12) - 1e-9, 0)


def root_above(square: np.ndarray) -> np.ndarray:
    """A number not below the root of an integer."""
    return np.sqrt(square.astype(np.float64)) * (1 + 1e-12) + 1e-9


def squares(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points, one row per point."""
    return ((points[:, None, :] - others[None, :, :]) ** 2).sum(axis=2)


@dataclass
class Gnat:
    """A node: either a leaf of entries, or split points with a subtree of the entries nearest to each.

    ``low`` and ``high`` have for split point j and subtree i bounds of the distances from j to what is in i.
    """

    entries: np.ndarray                 # indices; the split points, or all of a leaf
    points: np.ndarray
    children: list[Gnat | None] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @staticmethod
    def build(points: np.ndarray, entries: np.ndarray | None = None, splits: int = SPLITS, leaf: int = LEAF) -> Gnat:
        entries = np.arange(len(points)) if entries is None else entries
        if len(entries) <= max(leaf, splits):
            return Gnat(entries, points[entries])
        chosen = [0]  # split points far from each other: the farthest from those chosen, ties to the first
        apart = squares(points[entries], points[entries[:1]])[:, 0]
        while len(chosen) < splits:
            farthest = int(apart.argmax())
            if apart[farthest] == 0:
                return Gnat(entries, points[entries])  # copies of the split points only
            chosen.append(farthest)
            apart = np.minimum(apart, squares(points[entries], points[entries[[farthest]]])[:, 0])
        heads = entries[chosen]
        rest = np.delete(entries, chosen)
        distances = squares(points[rest], points[heads])
        home = distances.argmin(axis=1)
        low, high = np.full((splits, splits), np.inf), np.full((splits, splits), -np.inf)
        children: list[Gnat | None] = []
        for i in range(splits):
            own = rest[home == i]
            children.append(Gnat.build(points, own, splits, leaf) if len(own) else None)
            if len(own):
                low[:, i] = root_below(distances[home == i].min(axis=0))
                high[:, i] = root_above(distances[home == i].max(axis=0))
        return Gnat(heads, points[heads], children, low, high)

    def search(self, queries: np.ndarray, best: np.ndarray, nearest: np.ndarray, rows: np.ndarray) -> int:
        """Lower ``best`` (squared distances) and ``nearest`` (entries, ties to the least) for the queries ``rows``.

        A subtree is left out for a query only where a split point proves all of it strictly farther than the best.
        Returns the number of distances computed.
        """
        distances = squares(queries[rows], self.points)
        for column in range(len(self.entries)):
            d, entry = distances[:, column], self.entries[column]
            better = (d < best[rows]) | ((d == best[rows]) & (entry < nearest[rows]))
            best[rows[better]], nearest[rows[better]] = d[better], entry
        seen = distances.size
        if self.children:
            below, above = root_below(distances), root_above(distances)
            for i in np.argsort(distances.sum(axis=0), kind="stable"):
                child = self.children[i]
                if child is None:
                    continue
                # triangle inequality: what is in i lies at least this far from the query
                reach = np.maximum(self.low[:, i] - above, below - self.high[:, i]).max(axis=1)
                open_rows = rows[~(reach > root_above(best[rows]))]
                if len(open_rows):
                    seen += child.search(queries, best, nearest, open_rows)
        return seen


def nearest_entries(tree: Gnat, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each query."""
    best = np.full(len(queries), np.iinfo(np.int64).max)
    nearest = np.full(len(queries), np.iinfo(np.int64).max)
    tree.search(queries, best, nearest, np.arange(len(queries)))
    return nearest, best


def integer_vectors(rows: DataFrame, vector: str, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """The usable rows with the vector as integers, floor(scale * x), its length filled to a multiple of ``parts``.

    Rows go whose vector is null or empty or has null or non-finite components.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(
        F.lit(float(LARGEST)), F.floor(x.cast("double") * scale).cast("double"))).cast("int"))
    short = F.pmod(-F.size(vector), F.lit(parts))
    filled = F.when(short == 0, whole).otherwise(F.concat(whole, F.array_repeat(F.lit(0), short)))
    return rows.where(F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0)).withColumn(vector, filled)


def _parts(batch: pa.RecordBatch, column: str, parts: int) -> np.ndarray:
    """The vectors of a batch as an array of (row, part, position)."""
    own = batch.column(batch.schema.get_field_index(column))
    return own.flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, parts, -1)


def first_entries(vectors: DataFrame, entries: int = ENTRIES) -> np.ndarray | None:
    """The vectors of the smallest ids, null last, ties by their components; None of an empty table."""
    rows = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    size = len(rows[0]["v"]) if rows else 0
    return np.array([r["v"] for r in rows if len(r["v"]) == size], np.int64) if rows else None


def summed(vectors: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> number and component sums of the parts assigned to it; what goes to the driver is as
    large as the codebooks."""
    parts, entries, width = books.shape
    ship_package(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat.build(book) for book in books]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                cut = _parts(batch.slice(at, 2_000), "v", parts)
                for part, tree in enumerate(trees):
                    chosen, _ = nearest_entries(tree, cut[:, part])
                    np.add.at(count[part], chosen, 1)
                    np.add.at(total[part], chosen, cut[:, part])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]),
             pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    found = (vectors.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")
             .select("part", "entry", "n", F.posexplode("sums").alias("pos", "component"))
             .groupBy("part", "entry", "pos")
             .agg(F.sum("n").alias("n"), F.sum(F.col("component").cast("decimal(38,0)")).alias("total")).collect())
    sums: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for row in sorted(found, key=lambda r: r["pos"]):
        sums.setdefault((row["part"], row["entry"]), (row["n"], []))[1].append(int(row["total"]))
    return sums


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Entries as an array of (part, entry, position), after ``rounds`` rounds over all vectors.

    ``vectors`` has id and v, integer vectors of one length. Fewer vectors than entries give as many entries.
    """
    first = first_entries(vectors, entries)
    if first is None:
        return None
    books = first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        moved = books.copy()
        for (part, entry), (n, sums) in summed(vectors, books).items():
            moved[part, entry] = [total // n for total in sums]
        if (moved == books).all():
            break  # further rounds change nothing
        books = moved
    return books


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows (id, label, v) as (id, label, codes, error): entry per part, and the summed squared distances."""
    parts = len(books)
    trees: list[Gnat] = []

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not trees:
            trees.extend(Gnat.build(book) for book in books)
        cut = _parts(batch, "v", parts)
        found = [nearest_entries(tree, cut[:, part]) for part, tree in enumerate(trees)]
        codes = np.stack([entry for entry, _ in found], axis=1)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())),
             pa.array(sum(square for _, square in found))], names=["id", "label", "codes", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return over_batches(vectors.select("id", "label", "v"), assign,
                        f"id long, label {label}, codes array<int>, error long")


def label_errors(rows: DataFrame) -> DataFrame:
    """The rows with ``label_error``, the errors of their label; null is a label of its own.

    Errors are summed within tasks first and looked up again; a label with most of the rows is dealt to many tasks.
    """
    name = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    named = rows.withColumn("_label", name)
    totals = named.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return lookup_join(named, totals, ["_label"], "id").drop("_label")


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
               parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
               scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, label, codes, error, label_error), one per usable vector, and the codebooks.

    A vector is usable if it is not null, holds finite components only and is as long as the usable vector of the
    smallest id, after lengths that ``parts`` does not divide were filled with zeros. Components are floor(scale * x),
    held within 2^26 either way. Codebooks start from the vectors of the smallest ids (null ids last, ties by
    components), of which there may be fewer than ``entries``. Repeated rows count each; other columns are ignored;
    an empty table gives no rows and empty codebooks. Every round reads all vectors; only sums as large as the
    codebooks travel.
    """
    spark: SparkSession = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                          F.col(vector_col).alias("v"))
    whole = scratch.keep(integer_vectors(rows, "v", parts, scale))
    first = first_entries(whole, 1)
    if first is None:
        empty = whole.select("id", "label", F.array().cast("array<int>").alias("codes"),
                             F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty, np.zeros((parts, 0, 0), np.int64)
    same = whole.where(F.size("v") == first.shape[1])
    books = codebooks(same, parts, entries, rounds)
    return label_errors(scratch.keep(coded(same, books))), books


def books_sha256(books: np.ndarray) -> str:
    """Digest of all components by part, entry and position as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_text(codes: Column) -> Column:
    """Two hexadecimal digits for each part."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
