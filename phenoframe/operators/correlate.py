"""Correlation matrices in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from phenoframe.functions.masks import finite_or_null
from phenoframe.scale.bounds import materialised, small_table
from phenoframe.scale.ranks import average_ranks, row_ranks

FEW_VALUES = 10_000  # different values of a column whose ranks are looked up in a local table


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every pair of columns from one aggregation: ``(a, b, corr)``.

    A pair is taken over the rows where both values are finite.
    """
    df = df.select(*[finite_or_null(F.col(c).cast("double")).alias(c) for c in columns])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    aggs = [F.corr(columns[i], columns[j]).alias(f"_{i}_{j}") for i, j in pairs]

    def entry(i: int, j: int):
        value = F.col(f"_{min(i, j)}_{max(i, j)}")
        return F.struct(
            F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), value.alias("corr")
        )

    n = range(len(columns))
    rows = F.array(*[entry(i, j) for i in n for j in n])
    return df.agg(*aggs).select(F.explode(rows).alias("e")).select("e.*")


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of every pair of columns; equal values share their average rank.

    Non-finite values are missing. A pair is ranked on the rows where both values are known:
    all columns at once where nothing is missing, else pair by pair.
    """
    ranked = df.select(*[finite_or_null(F.col(c).cast("double")).alias(c) for c in columns])
    gaps = ranked.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    if not any(gaps):
        return _ranked_matrix(ranked, columns)
    n, parts = len(columns), []
    for i in range(n):
        for j in range(i, n):
            pair = [columns[i]] if i == j else [columns[i], columns[j]]
            both = _ranked_matrix(ranked.select(pair).dropna(), pair)
            parts.append(both.where("a <> b") if i < j else both)
    return reduce(DataFrame.unionByName, parts)


def _ranked_matrix(ranked: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of the average ranks of complete columns.

    Ranks of columns with few different values are looked up in a bounded local table. Rows of
    the other columns keep a key, are ranked in range-sorted partitions and meet by that key, so
    a frequent value is never a join key.
    """
    rows = materialised(ranked.withColumn("_row", F.monotonically_increasing_id()))
    sizes = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if sizes[c] <= FEW_VALUES // 2]
    many = [c for c in columns if c not in few]
    if many:
        placed = row_ranks(rows, "_row", many)
        by_row = [F.max(F.when(F.col("name") == c, F.col("rank"))).alias(f"_rank_{c}") for c in many]
        wide = placed.groupBy("_row").agg(*by_row)
        rows = rows.select("_row", *few).join(wide, "_row") if few else wide
    if few:
        ranks = materialised(average_ranks(rows, few))
    for c in few:
        own = ranks.where(F.col("name") == c).select(F.col("value").alias(c), F.col("rank").alias(f"_rank_{c}"))
        rows = rows.join(small_table(own, FEW_VALUES), c)
    return pearson_matrix(rows.select(*[F.col(f"_rank_{c}").alias(c) for c in columns]), columns)
