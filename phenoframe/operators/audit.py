"""Distributions, missing data and other checks on prepared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoframe.functions.masks import finite_or_null
from phenoframe.scale.bounds import materialised, small_table


def class_distribution(
    df: DataFrame, y: str, by: list[str] = [], class_dim: DataFrame | None = None
) -> DataFrame:
    """Count and percent per class within ``by``; with ``class_dim`` empty classes appear."""
    counts = df.groupBy(*by, y).agg(F.count(F.lit(1)).alias("n"))
    # the totals come from the counts, a row per stratum and class; null is a stratum too
    joined = counts.withColumn("_total", F.sum("n").over(Window.partitionBy(*by)))
    if class_dim is not None:
        classes = class_dim.select(y).distinct().agg(F.collect_list(y)).scalar()
        strata = joined.groupBy(*by).agg(F.max("_total").alias("_total"))
        dense = strata.select(*by, F.explode(classes).alias(y), F.lit(0).cast("bigint").alias("n"), "_total")
        known = F.array_contains(classes, F.col(y))
        joined = joined.where(known).unionByName(dense).groupBy(*by, y).agg(F.sum("n").alias("n"), F.max("_total").alias("_total"))
    return joined.select(
        *by, y, F.col("n").cast("bigint").alias("n"), (F.col("n") * 100.0 / F.col("_total")).alias("percent")
    )


def top_codes(df: DataFrame, code: str, k: int = 15) -> DataFrame:
    """The ``k`` most frequent codes."""
    counts = df.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), code).limit(k)


def missing_by_sample(samples: DataFrame, keys: list[str], mask: str = "mask") -> DataFrame:
    """Share of missing steps of every sample."""
    valid = F.size(F.filter(mask, lambda m: m))
    return samples.select(*keys, (F.lit(1.0) - valid / F.size(mask)).alias("missing_rate"))


def missing_by_step(samples: DataFrame, mask: str = "mask") -> DataFrame:
    """Share of missing samples of every step."""
    steps = samples.select(F.posexplode_outer(mask).alias("t", "m"))
    return steps.groupBy("t").agg((F.lit(1.0) - F.avg(F.col("m").cast("int"))).alias("missing_rate"))


def missing_summary(samples: DataFrame, mask: str = "mask") -> DataFrame:
    """Mean, minimum and maximum of both missing rates in one row; the masks are written once."""
    samples = materialised(samples.select(mask))
    per_sample = missing_by_sample(samples, [], mask).agg(
        F.avg("missing_rate").alias("sample_mean"),
        F.min("missing_rate").alias("sample_min"),
        F.max("missing_rate").alias("sample_max"),
    )
    per_step = missing_by_step(samples, mask).agg(F.avg("missing_rate").alias("m"))
    return per_sample.withColumn("step_mean", per_step.scalar())


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram of the finite values: ``(bucket, lower, upper, n)``."""
    values = df.select(finite_or_null(F.col(column).cast("double")).alias("v")).where(F.col("v").isNotNull())
    limits = values.agg(F.struct(F.min("v").alias("a"), F.max("v").alias("z"))).scalar()
    spread = values.withColumn("_l", limits)
    a, z = F.col("_l.a"), F.col("_l.z")
    bucket = F.when(a == z, F.lit(1)).otherwise(
        F.least(F.floor((F.col("v") - a) / ((z - a) / bins)) + 1, F.lit(bins))
    )
    counted = spread.groupBy(bucket.cast("int").alias("bucket"), "_l").agg(
        F.count(F.lit(1)).alias("n")
    )
    width = (z - a) / bins
    return counted.select(
        "bucket",
        (a + (F.col("bucket") - 1) * width).alias("lower"),
        (a + F.col("bucket") * width).alias("upper"),
        "n",
    )


def valid_step_stats(samples: DataFrame, by: list[str], mask: str = "mask") -> DataFrame:
    """Mean, minimum and maximum number of valid steps."""
    valid = F.size(F.filter(mask, lambda m: m))
    return samples.groupBy(*by).agg(
        F.avg(valid).alias("mean_valid"), F.min(valid).alias("min_valid"), F.max(valid).alias("max_valid")
    )


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null or NaN values per column: ``(name, n_missing, n_rows)``."""

    def missing(c: str) -> Column:
        numeric = dict(df.dtypes)[c] in ("double", "float")
        return F.col(c).isNull() | F.isnan(c) if numeric else F.col(c).isNull()

    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(missing(c)).alias(f"_{c}") for c in columns]
    )
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"_{c}").alias("n_missing")) for c in columns])
    return counts.select("n_rows", F.explode(entries).alias("e")).select("e.*", "n_rows")


def missing_in_series(samples: DataFrame, series: str = "series") -> Column:
    """Null or NaN values in one series."""
    return F.aggregate(
        series,
        F.lit(0),
        lambda acc, step: acc + F.size(F.filter(step, lambda x: x.isNull() | F.isnan(x))),
    )


def phenology(long: DataFrame, y: str, t: str, value: str) -> DataFrame:
    """Mean and population deviation of an index per class and step; only finite values count."""
    known = finite_or_null(F.col(value))
    return long.groupBy(y, t).agg(
        F.avg(known).alias("mean"), F.stddev_pop(known).alias("std"), F.count(known).alias("n")
    )


def seasonal_mean(values: Column) -> Column:
    """Mean over the steps that have a value; null when there is none."""
    kept = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(kept) > 0, total / F.size(kept))


def summary_report(df: DataFrame, y: str, code: str, k: int = 15) -> DataFrame:
    """Row counts, cardinalities, class counts and top codes in one row for a JSON sink."""
    counts = F.map_from_entries(F.collect_list(F.struct(F.col(y).cast("string"), "n")))
    per_class = small_table(df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))).agg(counts).scalar()
    ranked = F.collect_list(F.struct(F.col(code).cast("string").alias("code"), "n"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(code).alias("n_codes"), F.countDistinct(y).alias("n_classes")
    ).withColumns({"class_counts": per_class, "top_codes": top_codes(df, code, k).agg(ranked).scalar()})
