"""Exact medians whose task state stays bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from phenoframe.scale.bounds import materialised, small_table
from phenoframe.scale.ranks import slice_of


def split_medians(df: DataFrame, by: list[str], columns: list[str], slices: int = 256) -> DataFrame:
    """Exact medians per group for groups too large for one task; nulls are skipped.

    Values are counted first, spread over all tasks by value. Approximate quantiles cut
    each group into slices; slice totals show which slice holds the middle, and only that
    slice is put in order.
    """
    cells = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("_k"), F.col(c).cast("double").alias("_v")) for c in columns]
        )
    )
    long = df.select(*by, cells.alias("_x")).select(*by, "_x._k", "_x._v")
    counted = materialised(
        long.where(F.col("_v").isNotNull())
        .groupBy(*by, "_k", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    group = [*by, "_k"]
    shares = [i / slices for i in range(1, slices)]
    bounds = small_table(
        counted.groupBy(*group).agg(
            F.percentile_approx("_v", shares, 10_000).alias("_b"), F.sum("_n").alias("_t")
        )
    )
    placed = counted.join(bounds, group).withColumn(
        "_s", slice_of(F.col("_b"), F.col("_v"), slices)
    )
    running = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        placed.groupBy(*group, "_s", "_t")
        .agg(F.sum("_n").alias("_w"))
        .withColumn("_hi", F.sum("_w").over(running))
        .withColumn("_lo", F.col("_hi") - F.col("_w"))
    )
    low, high = F.floor((F.col("_t") - 1) / 2), F.floor(F.col("_t") / 2)
    middle = small_table(
        spans.where((F.col("_lo") <= high) & (F.col("_hi") > low)).select(*group, "_s", "_lo")
    )
    inside = Window.partitionBy(*group, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.join(middle, [*group, "_s"]).withColumn(
        "_end", F.col("_lo") + F.sum("_n").over(inside)
    )
    first = F.col("_end") - F.col("_n")
    pairs = ends.groupBy(*group).agg(
        F.max(F.when((first <= low) & (low < F.col("_end")), F.col("_v"))).alias("_a"),
        F.max(F.when((first <= high) & (high < F.col("_end")), F.col("_v"))).alias("_z"),
    )
    value = (F.col("_a") + F.col("_z")) / 2
    return pairs.groupBy(*by).agg(
        *[F.max(F.when(F.col("_k") == c, value)).alias(c) for c in columns]
    )


def column_medians(df: DataFrame, columns: list[str], max_distinct: int = 1_000_000) -> DataFrame:
    """One row of exact column medians.

    ``median`` keeps one entry per distinct value, so it is used while the distinct counts
    are small; wider columns go through :func:`split_medians`.
    """
    widths = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    if max(widths) <= max_distinct:
        return df.agg(*[F.median(c).alias(c) for c in columns])
    return split_medians(df.withColumn("_one", F.lit(1)), ["_one"], columns).select(*columns)
