"""Windows over long ordered groups, cut into time slices so that no group has to fit one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str, width: int) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group up to this one, by the integer ``order``.

    Two levels: each slice of ``width`` is summed, the sums before a slice are carried into it, and the rows are
    summed up within their slice. A task gets one slice, or one row per slice of a group. ``order`` should be
    different within a group; rows that tie may each count before the other. NULL groups count as a group.
    """
    group = F.struct(*by) if by else F.lit(0)
    sliced = df.withColumn("_sum_group", group).withColumn("_sum_slice", F.floor(F.col(order) / width))
    totals = sliced.groupBy("_sum_group", "_sum_slice").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy("_sum_group").orderBy("_sum_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_sum_group", "_sum_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_sum_carry"))
    within = Window.partitionBy("_sum_group", "_sum_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (sliced.join(carried, ["_sum_group", "_sum_slice"])
            .withColumn(name, F.col("_sum_carry") + F.sum(value).over(within))
            .drop("_sum_group", "_sum_slice", "_sum_carry"))


def trailing_sum(df: DataFrame, by: list[str], order: str, value: str, name: str, window: int,
                 width: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows at most ``window`` before this one, by the integer ``order``.

    A slice of ``width`` is also given the last ``window`` of the slice before, as a halo that is summed but not
    reported. So slices are independent of each other, and a row is copied once at most. By default a slice is
    twenty windows wide: one row in twenty is copied.
    """
    width = max(window + 1, width or 20 * window)
    own = F.floor(F.col(order) / width)
    reaches = F.col(order) >= (own + 1) * width - window
    sliced = df.withColumn("_sum_slice", F.explode(F.when(reaches, F.array(own, own + 1)).otherwise(F.array(own))))
    trailing = Window.partitionBy(*by, "_sum_slice").orderBy(order).rangeBetween(-window, 0)
    return (sliced.withColumn(name, F.sum(value).over(trailing))
            .where(F.col("_sum_slice") == own).drop("_sum_slice"))
