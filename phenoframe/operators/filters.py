"""Predicates on observations, acquisitions and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenoframe.functions.geo import within
from phenoframe.functions.masks import count_valid
from phenoframe.schemas import CLOUD_SCENE_CLASSES, MIN_CONFIDENCE_EXCLUSIVE, MIN_VALID_STEPS


def clear_scenes(obs: DataFrame, scene_class: str = "scl", drop: list[int] = CLOUD_SCENE_CLASSES) -> DataFrame:
    """Observations that are not saturated, shadowed, clouded or snow."""
    return obs.where(~F.col(scene_class).isin(drop))


def in_areas(points: DataFrame, areas, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points in any of the rectangles; plain range tests that reach the scan."""
    return points.where(within(F.col(lon), F.col(lat), areas))


def in_dates(obs: DataFrame, date_col: str, start: str, end: str) -> DataFrame:
    """Rows in ``[start, end)``, compared in the column's own type so that it reaches the scan."""
    kind = dict(obs.dtypes)[date_col]
    return obs.where(
        (F.col(date_col) >= F.lit(start).cast(kind)) & (F.col(date_col) < F.lit(end).cast(kind))
    )


def acquisitions(
    scenes: DataFrame, mode: str = "IW", polarisations: tuple[str, ...] = ("VV", "VH"),
    orbit: str | None = None, mode_col: str = "mode", pol_col: str = "polarisations",
    orbit_col: str = "orbit",
) -> DataFrame:
    """Scenes of one instrument mode with all polarisations, optionally of one orbit."""
    out = scenes.where(F.col(mode_col) == mode)
    for p in polarisations:
        out = out.where(F.array_contains(pol_col, p))
    return out if orbit is None else out.where(F.col(orbit_col) == orbit)


def confident(df: DataFrame, confidence: str, above: float = MIN_CONFIDENCE_EXCLUSIVE) -> DataFrame:
    """Rows with a confidence strictly above the limit."""
    return df.where(F.col(confidence) > above)


def enough_steps(samples: DataFrame, mask: str = "mask", at_least: int = MIN_VALID_STEPS) -> DataFrame:
    """Samples with enough valid steps."""
    return samples.where(count_valid(F.col(mask)) >= at_least)


def labelled(df: DataFrame, y: str, drop: tuple[str, ...] = (".geo", "system:time_start")) -> DataFrame:
    """Rows with a label, without the columns nobody needs."""
    return df.dropna(subset=[y]).drop(*drop)


def year_or_previous(obs: DataFrame, date_col: str, year: int, back: int = 1) -> DataFrame:
    """Rows of a year, or of the latest of the ``back`` years before it that has any.

    Only the existence of a row is looked up; other filters on ``obs`` stay in force.
    """
    for y in range(year, year - back, -1):
        rows = in_dates(obs, date_col, f"{y}-01-01", f"{y + 1}-01-01")
        if not rows.isEmpty():
            return rows
    return in_dates(obs, date_col, f"{year - back}-01-01", f"{year - back + 1}-01-01")
