"""Mixing sources to target weights: raked token weights, and sampling by calibrated probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import SPACE

OTHER = "other"     # stands for null and for every value that the targets do not name
SWEEPS = 12
MAX_CELLS = 100_000

Targets = dict[str, dict[str, float]]


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; zero for a null text."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))).cast("long")


def rake(cells: list[tuple], tokens: list[int], targets: Targets, sweeps: int = SWEEPS) -> np.ndarray:
    """Iterative proportional fitting: weights of the cells whose sums per value follow the targets.

    Cells name one value per dimension, in the order of ``targets``; they start from their tokens. Each sweep
    scales the cells of every value of every dimension to its target. A value's target is its share among
    the values that have tokens; ``other`` gets what the named ones leave of 1. A dimension none of whose values has
    both tokens and a target constrains nothing.
    """
    weights = np.array(tokens, np.float64)
    for name, shares in targets.items():
        if any(share < 0 for share in shares.values()) or sum(shares.values()) > 1 + 1e-9:
            raise ValueError(f"targets of {name} must be shares that sum to 1 at most")
    coded = []
    for place, (name, shares) in enumerate(targets.items()):
        values, code = np.unique([cell[place] for cell in cells], return_inverse=True) if cells else ([], [])
        wanted = np.array([shares.get(v, 0.0) if v != OTHER else max(0.0, 1 - sum(shares.values())) for v in values])
        if len(wanted) and wanted.sum() > 0:
            coded.append((np.asarray(code, np.int64), wanted / wanted.sum()))
    for _ in range(sweeps if cells else 0):
        for code, wanted in coded:
            now = np.bincount(code, weights=weights, minlength=len(wanted))
            weights = weights * (wanted / np.where(now > 0, now, 1))[code]
    return weights


def mixed(docs: DataFrame, targets: Targets, dimensions: dict[str, Column], id_col: str = "doc_id",
          text_col: str = "text", budget: int | None = None, seed: int = 7, sweeps: int = SWEEPS) -> DataFrame:
    """The rows with ``_tokens``, ``_expected`` (copies each should have) and ``_copies`` (drawn).

    ``targets`` gives shares of tokens by dimension and value, ``dimensions`` the columns that hold the
    values. Documents are summed to cells, whose number the named values bound; the cells are raked on the
    driver, and each document gets the copies its cell's weight asks for: the whole part surely, one more
    with the remaining probability, drawn from a hash of its id. The expected tokens are ``budget``, or
    as many as there are. A document without tokens is never drawn; a null id is drawn as one id; equal ids
    are drawn alike; a table without rows stays without. A dimension none of whose named values has tokens is left as
    it is. Other columns pass through, but that columns of the caller with these three names give way to them.
    """
    size = np.prod([len(shares) + 1 for shares in targets.values()])
    if size > MAX_CELLS:
        raise ValueError(f"the targets name {size} cells; at most {MAX_CELLS} can be raked")
    names = [f"cell_{i}" for i in range(len(targets))]
    coded = [F.when(dimensions[name].isin(*shares), dimensions[name]).otherwise(F.lit(OTHER)).alias(column)
             for column, (name, shares) in zip(names, targets.items())]
    # the caller's columns travel in one struct, so that their names meet no name of this operator
    own = [c for c in docs.columns if c not in ("_tokens", "_expected", "_copies")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(id_col).cast("string").alias("id"),
                       token_count(F.col(text_col)).alias("tokens"), *coded)
    found = rows.groupBy(*names).agg(F.sum("tokens").alias("total")).where("total > 0").orderBy(*names).collect()
    cells, tokens = [tuple(r[n] for n in names) for r in found], [r["total"] for r in found]
    weights = rake(cells, tokens, targets, sweeps)
    scale = (sum(tokens) if budget is None else budget) / max(weights.sum(), 1e-300)
    table = docs.sparkSession.createDataFrame(
        [(*cell, float(w * scale / t)) for cell, w, t in zip(cells, weights, tokens)],
        ", ".join(f"{n} string" for n in names) + ", wanted double")
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id"))), 1, 12), 16, 10)
    expected = F.when(F.col("tokens") > 0, F.coalesce("wanted", F.lit(0.0))).otherwise(0.0)
    more = (drawn.cast("double") / 2.0 ** 48 < expected - F.floor(expected)).cast("long")
    found = rows.join(F.broadcast(table), names, "left").select(  # at most MAX_CELLS rows
        "row", F.col("tokens").alias("_tokens"), expected.alias("_expected"), (F.floor(expected) + more).alias("_copies"))
    return found.select(*[F.col("row")[c].alias(c) for c in own], "_tokens", "_expected", "_copies")
