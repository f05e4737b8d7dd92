"""Temporal interpolation of dense and irregular series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from phenoframe.functions.gaps import bracketed
from phenoframe.functions.masks import finite_or_null


def fill_gaps(
    long: DataFrame,
    keys: list[str],
    t_col: str,
    columns: list[str],
    *,
    edge: str = "hold",
    fill: float = 0.0,
    mask: str | None = None,
) -> DataFrame:
    """Linear interpolation of missing steps (null, NaN or infinite), one row per key and step.

    ``edge`` rules the steps outside the valid range: ``hold`` the nearest valid value,
    ``fill`` with a constant, or ``leading_zero`` (0 before, hold after). A series without
    valid values becomes 0. With ``mask`` the valid steps are those where the mask is true,
    and a series without valid steps stays as it was.
    """
    order = F.col(t_col)
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy(*keys).orderBy(order.desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    out = long.withColumns({c: finite_or_null(F.col(c)) for c in columns})
    for c in columns:
        known = F.col(c).isNotNull() if mask is None else F.col(mask) & F.col(c).isNotNull()
        point = F.when(known, F.struct(order.cast("double").alias("t"), F.col(c).alias("v")))
        out = out.withColumn(f"_p_{c}", F.last(point, ignorenulls=True).over(past))
    for c in columns:
        known = F.col(c).isNotNull() if mask is None else F.col(mask) & F.col(c).isNotNull()
        point = F.when(known, F.struct(order.cast("double").alias("t"), F.col(c).alias("v")))
        out = out.withColumn(f"_n_{c}", F.last(point, ignorenulls=True).over(future))
    t = order.cast("double")
    done = {
        c: bracketed(
            t,
            F.col(f"_p_{c}"),
            F.col(f"_n_{c}"),
            edge,
            fill,
            F.lit(0.0) if mask is None else F.col(c),
        )
        for c in columns
    }
    return out.select(*[done[c].alias(c) if c in done else F.col(c) for c in long.columns])


def irregular_to_grid(
    obs: DataFrame,
    keys: list[str],
    t_col: str,
    value_col: str,
    *,
    start: float,
    step: float,
    n_steps: int,
    fill: float = 0.0,
) -> DataFrame:
    """Linear interpolation of irregular observations at ``start + i*step``.

    Grid points outside a key's observed range take ``fill``. Observations collapse to the
    first and last of each grid cell before rows of a key meet, so a key never brings more
    than ``n_steps + 1`` rows to a task, however many observations it has.
    """
    t = F.col(t_col).cast("double")
    cell = F.floor((t - F.lit(float(start))) / F.lit(float(step)))
    cell = F.least(F.greatest(cell, F.lit(-1)), F.lit(n_steps - 1)).cast("int")
    point = F.struct(t.alias("t"), F.col(value_col).cast("double").alias("v"))
    cells = (
        obs.where(finite_or_null(F.col(value_col)).isNotNull() & F.col(t_col).isNotNull())
        .groupBy(*keys, cell.alias("i"))
        .agg(F.min(point).alias("a"), F.max(point).alias("z"))
    )
    gathered = cells.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("i", F.struct("a", "z")))).alias("_m")
    )
    grid = gathered.select(
        *keys, "_m", F.explode(F.sequence(F.lit(-1), F.lit(n_steps - 1))).alias("i")
    ).select(
        *keys, "i", F.try_element_at("_m", F.col("i")).alias("c")
    )
    past = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    edges = grid.withColumn("_b", F.last("c.z", ignorenulls=True).over(past)).withColumn(
        "_a", F.last("c.a", ignorenulls=True).over(future)
    )
    at = F.lit(float(start)) + F.col("i") * F.lit(float(step))
    exact = F.col("_a.t") == at
    value = F.when(exact, F.col("_a.v")).otherwise(
        bracketed(at, F.col("_b"), F.col("_a"), "fill", fill, F.lit(fill))
    )
    return edges.where(F.col("i") >= 0).select(
        *keys, F.col("i").alias("t"), at.alias("grid_time"), value.alias(value_col)
    )
