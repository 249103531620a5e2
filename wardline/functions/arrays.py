"""Turning array elements into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keep: list, array: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per array element, with the kept columns and, if wanted, the position.

    Spark guards a plain explode with a filter on the array's size, pushed down to the scan, which
    computes a costly array twice. The outer form has no such filter; the row it adds for an empty
    array is dropped by its missing position.
    """
    at = pos or "_pos"
    rows = df.select(*keep, F.posexplode_outer(array).alias(at, name)).where(F.col(at).isNotNull())
    return rows if pos else rows.drop(at)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The table with costly columns that are computed once, whatever is done with them later.

    Spark pushes a filter on a derived column down to the scan and writes the column's expression
    into it, which computes the column twice and each repeated part of it again. A filter does not
    pass the generator used here. Its one-element array turns each row into one row.
    """
    staged = df.withColumns({f"_once_{name}": column for name, column in columns.items()})
    values = F.struct(*[F.col(f"_once_{name}").alias(name) for name in columns])
    return staged.select(*df.columns, F.inline(F.array(values)))
