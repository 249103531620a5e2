"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float],
                    steps_per_octave: int = 1024) -> DataFrame:
    """Interpolated quantiles, one row per group and probability: ``by..., probability, quantile``.

    Equal values are counted first, within tasks and then together; nothing later meets a raw row. Counts
    are added up per group and narrow value range (a fixed number per doubling), and the range totals say in
    which ranges the two order statistics around each quantile lie. Only the different values of those ranges are
    ranked. So a group, or a value, that holds a third of all rows needs no more than its few ranges in one task,
    unlike a percentile aggregate, which keeps all its values. The neighbouring values are interpolated linearly,
    which is the usual inclusive definition. NULL, NaN and infinite values are left out.
    """
    finite = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (
        F.abs(F.col(value).cast("double")) < F.lit(float("inf")))
    values = df.where(finite).select(*by, F.col(value).cast("double").alias("_v"))
    # monotone in the value: negative values mirror the positive ones, zero lies between
    magnitude = F.floor(F.log2(F.abs("_v")) * steps_per_octave) + F.lit(2_000 * steps_per_octave)
    ranged = values.withColumn("_range", F.when(F.col("_v") == 0, F.lit(0)).otherwise(
        magnitude * F.signum("_v")).cast("long"))
    counts = ranged.groupBy(*by, "_range", "_v").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    totals = counts.groupBy(*by, "_range").agg(F.sum("_n").alias("_total"))
    ranges = totals.withColumns({
        "_end": F.sum("_total").over(group.orderBy("_range")), "_rows": F.sum("_total").over(group)})
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    exact = F.col("probability") * (F.col("_rows") - 1)
    start = F.col("_end") - F.col("_total")

    def within(first: Column, last: Column) -> Column:
        low, high = F.floor("_exact"), F.ceil("_exact")
        return low.between(first, last) | high.between(first, last)

    targets = (ranges.withColumn("probability", wanted).withColumn("_exact", exact)
               .where(within(start, F.col("_end") - 1))
               .select(*[F.col(c).alias(f"_t_{c}") for c in by], F.col("_range").alias("_t_range"),
                       "probability", "_exact", start.alias("_before")))
    same = F.col("_range") == F.col("_t_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    slot = [*by, "_range", "probability"]
    counted = counts.join(targets, same).select(*slot, "_exact", "_before", "_v", "_n")
    last = F.col("_before") + F.sum("_n").over(Window.partitionBy(*slot).orderBy("_v")) - 1
    around = (counted.withColumn("_last", last)
              .where(within(F.col("_last") - F.col("_n") + 1, F.col("_last")))
              .groupBy(*by, "probability", "_exact")
              .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    share = F.col("_exact") - F.floor("_exact")
    return around.select(*by, "probability",
                         (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias("quantile"))


def approximate_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float],
                          accuracy: int = 10_000) -> DataFrame:
    """Sketched quantiles in one mergeable pass, for reports that need no exact rank."""
    sketch = F.percentile_approx(value, F.array(*[F.lit(float(p)) for p in probabilities]), accuracy)
    return (df.groupBy(*by).agg(sketch.alias("_q"))
            .select(*by, F.posexplode("_q").alias("_i", "quantile"))
            .withColumn("probability", F.element_at(
                F.array(*[F.lit(float(p)) for p in probabilities]), F.col("_i") + 1))
            .select(*by, "probability", "quantile"))


SKETCH_ITEMS = 1000    # size of a KLL sketch; a rank is then off by about a third of a percent


def quantile_sketches(df: DataFrame, by: list[str], value: str, items: int = SKETCH_ITEMS) -> DataFrame:
    """``by..., sketch, n``: a KLL sketch of the values of each group, to be stored and merged later.

    A sketch has a bounded size whatever the group's, and is built within tasks first. NULL, NaN and infinite
    values are left out; a group of nothing else has no row.
    """
    number = F.col(value).cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return (df.where(finite).withColumn("_v", number)
            .groupBy(*by).agg(F.kll_sketch_agg_double("_v", F.lit(items)).alias("sketch"), F.count("_v").alias("n")))


def merged_quantiles(sketches: DataFrame, by: list[str], probabilities: list[float],
                     items: int = SKETCH_ITEMS) -> DataFrame:
    """``by..., probability, quantile, n`` of stored sketches, merged over everything that ``by`` leaves out."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(items)).alias("_s"), F.sum("n").alias("n"))
    wanted = F.array(*[F.struct(
        F.lit(float(p)).alias("probability"),
        F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias("quantile")) for p in probabilities])
    return merged.select(*by, F.inline(wanted), "n")


def rank_errors(df: DataFrame, by: list[str], value: str, quantiles: DataFrame) -> DataFrame:
    """``quantiles`` with ``rank_error``: how far the share of values up to each is from its probability.

    Where equal values span the probability, the error is zero. The few quantiles meet counts of equal values.
    """
    finite = F.col(value).cast("double")
    counts = df.where(finite.isNotNull() & ~F.isnan(finite) & (F.abs(finite) < F.lit(float("inf")))).groupBy(
        *[F.col(c).alias(f"_c_{c}") for c in by], finite.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    below = F.sum(F.when(F.col("_v") < F.col("quantile"), F.col("_n")).otherwise(0))
    upto = F.sum(F.when(F.col("_v") <= F.col("quantile"), F.col("_n")).otherwise(0))
    share = (counts.join(quantiles, same).groupBy(*by, "probability", "quantile", "n")
             .agg((below / F.sum("_n")).alias("_low"), (upto / F.sum("_n")).alias("_high")))
    error = F.greatest(F.col("_low") - F.col("probability"), F.col("probability") - F.col("_high"), F.lit(0.0))
    return share.withColumn("rank_error", error).drop("_low", "_high")
