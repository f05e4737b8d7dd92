"""Map inference: raw pixel series to predicted classes and an error map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.functions.masks import valid_steps
from phenoframe.operators.scaling import apply_series_scaler
from phenoframe.operators.scoring import predicted, score


def model_input(series: Column, mask: Column) -> Column:
    """Series values step by step, followed by the step mask as 0 and 1."""
    return F.concat(F.flatten(series), F.transform(mask, lambda m: m.cast("double")))


def infer_map(
    pixels: DataFrame, scaler: DataFrame, load_model: Callable, *, n_steps: int, n_channels: int,
    label: str | None = None, series: str = "series", batch_size: int = 1024,
) -> DataFrame:
    """Score every pixel with a saved scaler and model; rows stay in their partitions.

    A step is valid when some channel is not zero. With ``label`` the result tells where the
    prediction is right, null where the label is below zero.
    """
    masked = pixels.withColumn("mask", valid_steps(F.col(series), "any_nonzero"))
    scaled = apply_series_scaler(masked, scaler, series=series)
    width = n_steps * (n_channels + 1)
    scored = score(
        scaled, model_input(F.col(series), F.col("mask")), width, load_model, batch_size=batch_size
    )
    return predicted(scored, label=label)
