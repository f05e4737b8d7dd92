"""Preparation paths from raw tables to a split, standardised dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenoframe.functions.arrays import append_mask_channel
from phenoframe.functions.gaps import fill_series
from phenoframe.functions.masks import finite_or_null, sanitise_series, valid_steps
from phenoframe.functions.temporal import resample_linear, resample_mask_nearest
from phenoframe.operators.align import coerce_id, inner_by_id, zero_modality
from phenoframe.operators.composite import (
    decadal_composite,
    dense_series,
    radar_columns,
)
from phenoframe.operators.filters import clear_scenes
from phenoframe.operators.sampling import equal_sample, paper_split, ratio_split, read_sampled
from phenoframe.operators.scaling import (
    apply_column_scaler,
    apply_series_scaler,
    fit_column_scaler,
    fit_series_scaler,
)
from phenoframe.scale.bounds import materialised
from phenoframe.schemas import BANDS, N_STEPS


def prepare_table(
    samples: DataFrame, key: str, y: str, bands: list[str] = BANDS, *,
    fill: bool = True, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Folded samples to a split, gap-filled and standardised dataset and its scaler.

    The filled samples are written once, since splitting, fitting and scaling each read them.
    """
    series = F.transform("series", lambda step: F.transform(step, finite_or_null))
    rows = samples.withColumn("series", series)
    if fill:
        rows = rows.withColumn("series", fill_series(F.col("series"), len(bands)))
    rows = materialised(rows.withColumn("series", sanitise_series(F.col("series"))))
    split = paper_split(rows, y, [key], seed=seed)
    scaler = fit_series_scaler(split, bands)
    return apply_series_scaler(split, scaler), scaler


def prepare_scenes(
    labels: DataFrame, observations: DataFrame, key: str, y: str, date_col: str, bands: list[str], *,
    year: int, max_samples: int = 20_000, seed: int = 42, scene_class: str | None = "scl",
) -> DataFrame:
    """Sample labelled pixels first, then composite only their observations."""
    points = equal_sample(labels, y, [key], max_samples, seed)
    clear = clear_scenes(observations, scene_class) if scene_class else observations
    wanted = read_sampled(clear, points, [key])
    composite = decadal_composite(wanted, [key], date_col, bands, year=year)
    series = dense_series(composite, [key], bands, N_STEPS)
    blank = F.array_repeat(F.array(*[F.lit(0.0) for _ in bands]), N_STEPS)
    return points.join(series, key, "left").withColumns(
        {
            "series": F.coalesce("series", blank),
            "mask": F.coalesce("mask", F.array_repeat(F.lit(False), N_STEPS)),
        }
    )


def align_modalities(
    samples: DataFrame, covariates: DataFrame, statics: list[str], radar: DataFrame | None = None, *,
    id_col: str = "id", n_in: int = N_STEPS, resample: int | None = None, mask_channel: bool = False,
) -> DataFrame:
    """Samples with radar and static columns, joined on id; absent radar is zero."""
    cov = coerce_id(covariates, id_col).select(id_col, *statics)
    s1 = zero_modality(cov, id_col, radar_columns()) if radar is None else coerce_id(radar, id_col)
    joined = inner_by_id(inner_by_id(samples, s1.select(id_col, *radar_columns()), id_col), cov, id_col)
    if resample is not None:
        valid = valid_steps(F.col("series"), "any_above_eps")
        joined = joined.withColumns(
            {
                "mask": resample_mask_nearest(valid, n_in, resample),
                "series": resample_linear(F.col("series"), n_in, resample),
            }
        )
        if mask_channel:
            joined = joined.withColumn("series", append_mask_channel(F.col("series"), F.col("mask")))
    numbers = [*radar_columns(), *statics]
    finite = {
        c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).otherwise(0.0)
        for c in numbers
    }
    return joined.withColumns(finite).withColumn("series", sanitise_series(F.col("series")))


def standardise_modalities(
    aligned: DataFrame, statics: list[str], y: str = "y", id_col: str = "id", channels: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Ratio split, then every value standardised by the training rows.

    Series are scaled per step and channel, radar and static columns per column.
    """
    split = ratio_split(materialised(aligned), [y], [id_col], seed=seed)
    names = [f"c{i}" for i in range(channels or len(BANDS))]
    series = apply_series_scaler(split, fit_series_scaler(split, names, per_step=True), per_step=True)
    columns = [*radar_columns(), *statics]
    return apply_column_scaler(series, fit_column_scaler(split, columns), columns)
