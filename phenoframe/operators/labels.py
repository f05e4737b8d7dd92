"""Label tables: dense indices, lookups and eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from phenoframe.functions.labels import eligible
from phenoframe.scale.bounds import small_table
from phenoframe.scale.ranks import sequential_id


def dense_codes(df: DataFrame, code: str, ignore: list[int] = [0], out: str = "class_id") -> DataFrame:
    """Distinct codes in order with indices 0..K-1: ``(code, out)``, usable both ways."""
    kept = F.col(code).isNotNull() & (F.col(code) >= 0) & ~F.col(code).isin(ignore)
    codes = df.where(kept).select(code).distinct()
    few = small_table(codes)
    if few is codes:
        return sequential_id(codes, [code], out)
    return few.withColumn(out, (F.dense_rank().over(Window.orderBy(code)) - 1).cast("bigint"))


def remap_dense(df: DataFrame, code: str, codes: DataFrame) -> DataFrame:
    """Attach dense indices; ignored and unknown codes get null."""
    return df.join(codes, code, "left")


def lookup_class(
    df: DataFrame, code: str, mapping: DataFrame, value: str, unknown: int = -1, drop_unknown: bool = False
) -> DataFrame:
    """Class of a code from a mapping table, ``unknown`` where it is not listed.

    A mapping of at most 10,000 rows becomes a local relation, so that frequent codes do not meet
    in one task; a larger one is joined by code.
    """
    joined = df.join(small_table(mapping), code, "left").withColumn(value, F.coalesce(F.col(value), F.lit(unknown)))
    return joined.where(F.col(value) != unknown) if drop_unknown else joined


def label_eligible(
    grid: DataFrame, label: str, code: str, confidence: str | None = None, land_cover: str | None = None,
    min_confidence: float = 95.0, cropland: int = 40,
) -> DataFrame:
    """Null the label of pixels that may not be sampled."""
    keep = eligible(
        F.col(code),
        None if confidence is None else F.col(confidence),
        None if land_cover is None else F.col(land_cover),
        min_confidence,
        cropland,
    )
    return grid.withColumn(label, F.when(keep, F.col(label)))
