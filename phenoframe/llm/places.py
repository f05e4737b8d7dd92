"""Numbers of rows within groups of any size, and lookups that a large group cannot stall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from phenoframe.scale.bounds import materialised, small_table

HOT_GROUPS = 2000  # at most so many groups are ever broadcast by ``attach``


def runs(df: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows sorted across tasks, and where each task's run of a group starts.

    The first table is ``df`` with ``_part`` and ``_m``, range-partitioned and sorted by group
    and order; equal rows are told apart, so even those spread over tasks. The second has, per
    group and part, ``_first`` (its least ``_m``), ``_before`` (rows of the group in earlier
    parts) and ``_total``. A row's number from 0 is ``_before + _m - _first``. Group columns
    must not be null; ``df`` is read twice and should be a written table.
    """
    by = [*group, *order, "_row"]
    rows = df.withColumn("_row", F.monotonically_increasing_id()).orderBy(*by).drop("_row")
    table = materialised(rows.withColumn("_m", F.monotonically_increasing_id()))
    table = table.withColumn("_part", F.shiftrightunsigned("_m", 33))
    counted = table.groupBy(*group, "_part").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(
        *group,
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )
    return table, materialised(starts)


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_at`` (number from 0 in the group) and ``_total`` (rows of the group)."""
    table, starts = runs(df, group, order)
    at = F.col("_before") + F.col("_m") - F.col("_first")
    return table.join(starts, [*group, "_part"]).select(*df.columns, at.alias("_at"), "_total")


def attach(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """``rows`` left-joined to ``groups``, whose ``size`` counts the rows with that key.

    Groups with more than a 2,000th of all rows, of which there are fewer than 2,000, are
    broadcast, so that their rows stay where they are; the rest is joined by key. Both tables
    are read twice and should be written ones.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) > total // HOT_GROUPS)
    hot = F.broadcast(small_table(hot.drop(size), HOT_GROUPS))
    rest = groups.where(F.col(size) <= total // HOT_GROUPS).drop(size)
    apart = rows.join(hot, on, "left_anti").join(rest, on, "left")
    return rows.join(hot, on).unionByName(apart)
