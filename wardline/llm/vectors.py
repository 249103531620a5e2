"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative a group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, components, over_batches

MIN_COSINE = 0.98
CELL_ROWS = 2_000     # distinct vectors a cell should hold
MAX_CELLS = 1_024     # bound of the centres every task gets
FIT_ROWS = 100_000    # vectors, taken by hash, to which the cells are fitted; every vector is assigned
BLOCK_ROWS = 1_024    # vectors a task multiplies with as many others


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(node, label, v, n): every distinct usable vector of a label with its number of rows and least id.

    A vector is usable if it is not null, holds finite components only and is not zero, and if its label
    and id are not null. The double-precision components are scaled to unit length.
    """
    v = F.col("v")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    grouped = (rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & fine)
               .groupBy("label", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
               .withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < F.lit(math.inf))))
    return grouped.select("node", "label", "v", "n",
                          F.transform("v", lambda x: x.cast("double") / F.col("norm")).alias("u"))


def centres(distinct: DataFrame, cell_rows: int = CELL_ROWS, fit_rows: int = FIT_ROWS) -> dict[int, np.ndarray]:
    """Unit centres of spherical k-means, by dimension of the vectors."""
    found = {}
    for row in distinct.groupBy(F.size("u").alias("d")).count().collect():
        k = max(1, min(MAX_CELLS, math.ceil(row["count"] / cell_rows)))
        own = distinct.where(F.size("u") == row["d"])
        if k == 1:
            found[row["d"]] = np.zeros((1, row["d"]))
            continue
        share = max(1, row["count"] // fit_rows)
        own = own.where(F.pmod(F.xxhash64("u"), F.lit(share)) == 0)
        model = KMeans(k=k, maxIter=8, seed=17, distanceMeasure="cosine").fit(
            own.select(array_to_vector("u").alias("features")))
        means = np.array(model.clusterCenters())
        found[row["d"]] = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-300)
    return found


def assigned(distinct: DataFrame, cells: dict[int, np.ndarray], min_cosine: float = MIN_COSINE) -> DataFrame:
    """The vectors with ``home``, the cell of the nearest centre, and ``cells``, all cells they enter.

    Two unit vectors at the least cosine lie r = sqrt(2 - 2 cosine) apart. If their homes differ, both lie
    within r of the plane halfway between the two centres, and one of them within r / 2. A vector therefore
    also enters every cell whose plane is within r / 2, and meets its partner in one of the two homes: no
    link is lost at a border.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * min_cosine)) / 2 + 1e-9

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        homes, entered = [], []
        for u in batch.column(batch.schema.get_field_index("u")).to_numpy(zero_copy_only=False):
            own = cells[len(u)]
            near = own @ u
            home = int(near.argmax())
            apart = np.linalg.norm(own - own[home], axis=1)
            homes.append(home)
            entered.append(np.flatnonzero(near[home] - near <= reach * apart).tolist())
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(homes, pa.int32()), pa.array(entered, pa.list_(pa.int32()))],
            names=[*batch.schema.names, "home", "cells"])

    label = distinct.schema["label"].dataType.simpleString()
    return over_batches(distinct.select("node", "label", "n", "u"), assign,
                        f"node long, label {label}, n long, u array<double>, home int, cells array<int>")


def blocks(entered: DataFrame, scratch: Scratch, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows dealt to pairs of blocks of one label and cell; a pair holds about two blocks at most.

    A cell is cut into as many blocks as its size asks for, so that no task holds a cell, however many
    vectors gather in it.
    """
    rows = entered.select("*", F.size("u").alias("d"), F.explode("cells").alias("cell"))
    sizes = scratch.keep(rows.groupBy("label", "d", "cell").agg(F.count(F.lit(1)).alias("members"))
                         .withColumn("cuts", F.ceil(F.col("members") / block_rows).cast("int")).drop("members"))
    own = F.pmod(F.xxhash64("node", "u"), F.col("cuts")).cast("int")
    return (rows.join(sizes, ["label", "d", "cell"]).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))


def compared(dealt: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(node, other, links): edges that join what is linked, and the links of each vector in each block pair."""
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, i, j = key[2], key[3], key[4]
        u = np.stack(rows["u"].to_numpy())
        node, n, home = (rows[c].to_numpy() for c in ("node", "n", "home"))
        first = rows["own"].to_numpy() == i
        linked = u @ u.T >= min_cosine
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= first[:, None] != first[None]
        linked &= (home == cell)[:, None] | (home == cell)[None]
        none = pd.DataFrame({"node": pd.Series(dtype="int64"), "other": pd.Series(dtype="Int64"),
                             "links": pd.Series(dtype="int64")})
        at = np.flatnonzero(linked.any(axis=1))
        if not len(at):
            return none
        linked, node, n, home = linked[np.ix_(at, at)], node[at], n[at], home[at]
        names, code = np.unique(home, return_inverse=True)
        inside = np.zeros((len(at), len(names)), bool)
        for row, cells in enumerate(rows["cells"].to_numpy()[at]):
            inside[row] = np.isin(names, cells)
        twice = inside[:, code] & inside[:, code].T  # each enters the other's home: counted in the lesser one
        counted = linked & ~(twice & (np.minimum(home[:, None], home[None]) != cell))
        links = counted.astype(np.float64) @ n.astype(np.float64)
        root = np.arange(len(at))
        while True:
            low = np.minimum(root, np.where(linked, root[None], len(at)).min(axis=1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        away = np.flatnonzero(root != np.arange(len(at)))
        return pd.concat([
            pd.DataFrame({"node": node, "other": pd.array([None] * len(at), "Int64"), "links": links.astype("int64")}),
            pd.DataFrame({"node": node[away], "other": pd.array(node[root[away]], "Int64"),
                          "links": np.zeros(len(away), "int64")})])

    return (dealt.select("label", "d", "cell", "i", "j", "node", "n", "u", "home", "cells", "own")
            .groupBy("label", "d", "cell", "i", "j").applyInPandas(compare, "node long, other long, links long"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", min_cosine: float = MIN_COSINE, cell_rows: int = CELL_ROWS,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: (id, n_links, component, kept).

    Vectors of one label link from ``min_cosine`` on, computed in double precision; equal vectors are one
    node that counts its rows. Vectors that are null, empty, zero or hold null or non-finite components, or
    whose label is null, link with nothing and stand for themselves. A null id links with nothing and has a
    null component. Rows that repeat an id share its component. Vectors of different dimension never link.
    Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"),
                          F.col(label_col).alias("label"))
    distinct = scratch.keep(distinct_vectors(rows))
    entered = scratch.keep(assigned(distinct, centres(distinct, cell_rows), min_cosine))
    pairs = scratch.keep(compared(blocks(entered, scratch, block_rows), min_cosine))
    joined = components(pairs.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")),
                        scratch)
    links = pairs.groupBy("node").agg(F.sum("links").alias("links"))
    joined = joined.withColumnRenamed("label", "component")
    found = scratch.keep(distinct.join(links, "node", "left").join(joined, "node", "left").select(
        F.col("label").alias("_label"), F.col("v").alias("_v"), F.coalesce("component", "node").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    matched = rows.join(found, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v"))
                        & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return matched.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                          component.alias("component"), (F.col("id") == component).alias("kept"))
