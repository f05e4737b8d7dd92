"""Ten-day composites, dense series, monthly radar means and climate aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.functions.masks import finite_or_null
from phenoframe.functions.temporal import decadal_bin
from phenoframe.scale.bounds import heavy_keys
from phenoframe.scale.medians import split_medians
from phenoframe.schemas import N_STEPS, RADAR_CHANNELS, STEP_DAYS


def any_value(bands: list[str]) -> Column:
    """Some band of the row has a value."""
    return reduce(lambda a, b: a | b, [F.col(b).isNotNull() for b in bands])


def binned(
    obs: DataFrame,
    date_col: str,
    bands: list[str],
    year: int | None = None,
    n_bins: int = N_STEPS,
    bin_days: int = STEP_DAYS,
    tail: str = "clamp",
) -> DataFrame:
    """Observations with their year and bin; non-finite band values become null.

    Observations without a date are left out.

    With ``tail='drop'`` the last date of each year is excluded as well as the days past
    the last bin, like a half-open date range over the year.
    """
    rows = obs if year is None else obs.where(
        (F.col(date_col) >= F.make_date(F.lit(year), F.lit(1), F.lit(1)))
        & (F.col(date_col) < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1)))
    )
    kept = [c for c in obs.columns if c not in bands]
    out = rows.select(
        *kept,
        *[finite_or_null(F.col(b)).alias(b) for b in bands],
        F.year(date_col).alias("year"),
        decadal_bin(F.col(date_col), n_bins, bin_days, tail).alias("bin"),
    )
    return out.where(F.col("bin").isNotNull())


def decadal_composite(
    obs: DataFrame,
    keys: list[str],
    date_col: str,
    bands: list[str],
    *,
    year: int | None = None,
    n_bins: int = N_STEPS,
    bin_days: int = STEP_DAYS,
    tail: str = "clamp",
    mask_rule: str = "any",
    hot_rows: int | None = 5_000_000,
    masks: dict[str, str] | None = None,
) -> DataFrame:
    """Median of each band per key, year and bin that has observations.

    ``valid`` follows ``mask_rule``: ``any`` when some band has a value, or the name of the
    band whose values are counted; ``masks`` names further masks by rule. All rows of a key meet in one task, which serves the
    median here and any later step keyed the same way; keys with more than ``hot_rows``
    rows are composited by value counts instead.
    """
    rows = binned(obs, date_col, bands, year, n_bins, bin_days, tail)
    rows = rows.select(*keys, "year", "bin", *bands)
    group = [*keys, "year", "bin"]
    flags = []
    for name, rule in {"valid": mask_rule, **(masks or {})}.items():
        tested = any_value(bands) if rule == "any" else F.col(rule).isNotNull()
        flags.append((F.count_if(tested) > 0).alias(name))
    hot = heavy_keys(rows, keys, hot_rows) if hot_rows else None

    cold = rows if hot is None else rows.join(hot, keys, "left_anti")
    simple = cold.repartition(*keys).groupBy(*group).agg(
        *[F.median(b).alias(b) for b in bands], *flags
    )
    if hot is None:
        return simple
    large = rows.join(hot, keys, "left_semi")
    medians = split_medians(large, group, bands)
    valid = large.groupBy(*group).agg(*flags)
    return simple.unionByName(valid.join(medians, group, "left").select(*simple.columns))


def dense_series(
    composite: DataFrame,
    keys: list[str],
    bands: list[str],
    n_bins: int = N_STEPS,
    empty: float | None = 0.0,
) -> DataFrame:
    """One row per key with ``series[t][c]`` and ``mask[t]`` over all bins.

    A key has at most ``n_bins`` composites, so gathering them is bounded. Composites that
    are already partitioned by (part of) the key are not shuffled again.
    """
    gathered = composite.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    F.col("bin"),
                    F.struct(
                        F.col("valid"),
                        F.array(*[F.col(b).cast("double") for b in bands]).alias("v"),
                    ),
                )
            )
        ).alias("_bins")
    )
    blank = F.lit(empty).cast("double")
    steps = F.sequence(F.lit(0), F.lit(n_bins - 1))

    def step(t: Column) -> Column:
        values = F.coalesce(
            F.try_element_at("_bins", t)["v"], F.array(*[blank for _ in bands])
        )
        return values if empty is None else F.transform(values, lambda x: F.coalesce(x, blank))

    mask = F.transform(
        steps, lambda t: F.coalesce(F.try_element_at("_bins", t)["valid"], F.lit(False))
    )
    return gathered.select(*keys, F.transform(steps, step).alias("series"), mask.alias("mask"))


def series_to_long(samples: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """One row per step with one column per band and the step mask."""
    zipped = F.arrays_zip(F.col("series"), F.col("mask"))
    exploded = samples.select(*keys, F.posexplode_outer(zipped).alias("t", "_z"))
    return exploded.select(
        *keys,
        "t",
        *[F.get("_z.series", F.lit(i)).alias(b) for i, b in enumerate(bands)],
        F.col("_z.mask").alias("valid"),
    )


def long_to_series(long: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """The inverse of :func:`series_to_long`; a key has one row per step."""
    rows = F.collect_list(F.struct("t", F.array(*bands).alias("v"), "valid"))
    ordered = long.groupBy(*keys).agg(F.array_sort(rows).alias("_r"))
    return ordered.select(
        *keys,
        F.transform("_r", lambda r: r["v"]).alias("series"),
        F.transform("_r", lambda r: r["valid"]).alias("mask"),
    )


def monthly_radar(
    obs: DataFrame,
    id_col: str,
    date_col: str,
    vv: str = "vv",
    vh: str = "vh",
    fallback: str = "collection",
) -> DataFrame:
    """Monthly means as ``ratio_MM, vh_MM, vv_MM`` per id, from one grouped pass.

    ``collection``: a month without any acquisition takes the yearly mean. ``pixel``: so
    does a month in which this id has none. Months still empty are 0.
    """
    month = F.month(date_col)
    obs = obs.withColumns({c: finite_or_null(F.col(c)) for c in (vv, vh)})
    means = [F.avg(c).alias(f"_{c}") for c in (vv, vh)]
    for m in range(1, 13):
        means += [F.avg(F.when(month == m, F.col(c))).alias(f"_{c}_{m}") for c in (vv, vh)]
    grouped = obs.groupBy(id_col).agg(*means)
    if fallback == "collection":
        present = obs.agg(F.collect_set(month).alias("m")).scalar()  # at most twelve values
        grouped = grouped.withColumn("_present", present)

    columns: dict[str, Column] = {}
    for m in range(1, 13):
        value = {}
        for c in (vv, vh):
            own, yearly = F.col(f"_{c}_{m}"), F.col(f"_{c}")
            if fallback == "collection":
                own = F.when(F.array_contains("_present", m), own).otherwise(yearly)
            else:
                own = F.coalesce(own, yearly)
            value[c] = own
        columns[f"ratio_{m:02d}"] = F.coalesce(value[vh] - value[vv], F.lit(0.0))
        columns[f"vh_{m:02d}"] = F.coalesce(value[vh], F.lit(0.0))
        columns[f"vv_{m:02d}"] = F.coalesce(value[vv], F.lit(0.0))
    return grouped.select(id_col, *[c.alias(n) for n, c in columns.items()])


def radar_columns(n_months: int = 12) -> list[str]:
    """Monthly radar columns in channel order."""
    return [f"{c}_{m:02d}" for m in range(1, n_months + 1) for c in RADAR_CHANNELS]


def climate_aggregate(
    daily: DataFrame, id_col: str, date_col: str, start: str, end: str,
    temp_max: str = "temp_max", temp_min: str = "temp_min", precip: str = "precip",
) -> DataFrame:
    """Mean of daily extremes and total precipitation over ``[start, end)``."""
    rows = daily.where((F.col(date_col) >= F.lit(start).cast("date")) & (F.col(date_col) < F.lit(end).cast("date")))
    known = {c: finite_or_null(F.col(c)) for c in (temp_max, temp_min, precip)}
    return rows.groupBy(id_col).agg(
        F.avg(known[temp_max]).alias("temp_max"),
        F.avg(known[temp_min]).alias("temp_min"),
        F.sum(known[precip]).alias("precip_sum"),
    )
