"""Standardisation, imputation and class weights, fitted on the training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.functions.masks import finite_or_null
from phenoframe.scale.bounds import small_table
from phenoframe.scale.medians import column_medians

TRAIN = "train"


def training(df: DataFrame, split: str | None = "split") -> DataFrame:
    """Training rows, or all rows when there is no split column to go by."""
    return df if split is None else df.where(F.col(split) == TRAIN)


def _stats(columns: list[Column], names: list[str]) -> Column:
    return F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("c"),
                    F.lit(n).alias("name"),
                    F.col(f"_m{i}").alias("mean"),
                    F.col(f"_s{i}").alias("std"),
                )
                for i, n in enumerate(names)
            ]
        )
    )


def fit_series_scaler(
    samples: DataFrame, names: list[str], *, series: str = "series", per_step: bool = False,
    split: str | None = "split",
) -> DataFrame:
    """Mean and population deviation per channel, or per step and channel.

    Returns ``(t, c, name, mean, std)`` with ``t`` null for the per-channel fit: as many
    rows as the series has values, whatever the number of samples. Only finite values count.
    """
    steps = training(samples, split).select(F.posexplode_outer(series).alias("t", "_x"))
    values = [finite_or_null(F.get("_x", F.lit(i)).cast("double")) for i in range(len(names))]
    aggs = [F.avg(v).alias(f"_m{i}") for i, v in enumerate(values)]
    aggs += [F.stddev_pop(v).alias(f"_s{i}") for i, v in enumerate(values)]
    if per_step:
        fitted = steps.groupBy("t").agg(*aggs)
    else:
        fitted = steps.agg(*aggs).withColumn("t", F.lit(None).cast("int"))
    return fitted.select("t", _stats(values, names).alias("_x")).select("t", "_x.*")


def fit_column_scaler(df: DataFrame, columns: list[str], split: str | None = "split") -> DataFrame:
    """Mean and population deviation of the finite values per column: ``(c, name, mean, std)``."""
    rows = training(df, split)
    known = [finite_or_null(F.col(c).cast("double")) for c in columns]
    aggs = [F.avg(v).alias(f"_m{i}") for i, v in enumerate(known)]
    aggs += [F.stddev_pop(v).alias(f"_s{i}") for i, v in enumerate(known)]
    return rows.agg(*aggs).select(_stats([], columns).alias("_x")).select("_x.*")


def divisor(std: Column, eps: float | None = None) -> Column:
    """The deviation to divide by: 1 for a constant, or the deviation plus ``eps``."""
    return F.when(std == 0, F.lit(1.0)).otherwise(std) if eps is None else std + F.lit(eps)


def apply_series_scaler(
    samples: DataFrame, scaler: DataFrame, *, series: str = "series", per_step: bool = False,
    eps: float | None = None,
) -> DataFrame:
    """Standardise every channel. The scaler is one small row of arrays, not a join."""
    pair = F.struct("c", "mean", divisor(F.col("std"), eps).alias("std"))
    if per_step:
        per_t = scaler.groupBy("t").agg(F.array_sort(F.collect_list(pair)).alias("s"))
        table = per_t.agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "s"))), lambda r: r["s"]))
    else:
        table = scaler.agg(F.array_sort(F.collect_list(pair)))
    scaled = samples.withColumn("_stats", table.scalar())

    def standard(step: Column, stats: Column) -> Column:
        return F.zip_with(step, stats, lambda x, s: (x - s["mean"]) / s["std"])

    if per_step:
        value = F.zip_with(F.col(series), F.col("_stats"), standard)
    else:
        value = F.transform(series, lambda step: standard(step, F.col("_stats")))
    return scaled.withColumn(series, value).drop("_stats")


def apply_column_scaler(df: DataFrame, scaler: DataFrame, columns: list[str], eps: float | None = None) -> DataFrame:
    """Standardise plain columns by name."""
    entry = F.struct("name", F.struct("mean", divisor(F.col("std"), eps).alias("std")))
    table = scaler.agg(F.map_from_entries(F.collect_list(entry)))
    scaled = df.withColumn("_stats", table.scalar())
    value = {
        c: (F.col(c) - F.col("_stats")[c]["mean"]) / F.col("_stats")[c]["std"] for c in columns
    }
    return scaled.withColumns(value).drop("_stats")


def impute_median(df: DataFrame, columns: list[str], split: str | None = "split") -> DataFrame:
    """Null and NaN become the exact median of the training rows; columns become doubles."""
    number = {c: F.col(c).cast("double") for c in columns}
    clean = df.withColumns({c: F.when(~F.isnan(v), v) for c, v in number.items()})
    medians = column_medians(training(clean, split), columns).first()
    return clean.fillna({c: medians[c] for c in columns if medians[c] is not None})


def impute_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null and NaN become 0."""
    return df.withColumns(
        {c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c)).otherwise(F.lit(0.0)) for c in columns}
    )


def class_counts(df: DataFrame, y: str, split: str | None = "split") -> DataFrame:
    """Rows per class: ``(y, n)``."""
    return training(df, split).where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))


def class_weights(
    df: DataFrame, y: str, *, split: str | None = "split", boost: float = 1.0
) -> DataFrame:
    """Balanced weights ``N/(K*n)``; classes below the median count are boosted."""
    counts = small_table(class_counts(df, y, split))
    totals = counts.agg(
        F.struct(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.median("n").alias("mid")
        )
    ).scalar()
    weighed = counts.withColumn("_t", totals)
    balanced = F.col("_t.total") / (F.col("_t.k") * F.col("n"))
    lift = F.when(F.col("n") < F.col("_t.mid"), F.lit(float(boost))).otherwise(F.lit(1.0))
    return weighed.select(y, "n", (balanced * lift).alias("weight"))


def sample_weights(df: DataFrame, y: str, weights: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Class weight of every row over the mean weight of all rows, null without a class.

    The mean comes from the class counts, so the rows are not aggregated again.
    """
    table = small_table(weights)
    mean = table.agg((F.sum(F.col("n") * F.col("weight")) / F.sum("n"))).scalar()
    scaled = table.select(y, (F.col("weight") / (mean + F.lit(eps))).alias("sample_weight"))
    return df.join(scaled, y, "left")
