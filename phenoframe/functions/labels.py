"""Crop codes, classes and per-row class decisions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from phenoframe.schemas import ARKANSAS_CODES, CALIFORNIA_CODES


def mapped(code: Column, mapping: dict[int, int]) -> Column:
    """Class of a code by a small literal mapping; null when it is not listed."""
    pairs = [F.lit(v) for pair in mapping.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))


def code_class(code: Column, variant: str) -> Column:
    """Class of a crop code; null means the pixel is ignored.

    ``california``: five crops, every other code Others. ``arkansas``: four crops, every
    other code Others. ``arkansas_60`` and ``arkansas_61``: codes up to 60 or 61 are Others,
    the rest is ignored.
    """
    if variant == "california":
        return F.when(code.isNotNull(), F.coalesce(mapped(code, CALIFORNIA_CODES), F.lit(5)))
    main = mapped(code, ARKANSAS_CODES)
    if variant == "arkansas":
        return F.when(code.isNotNull(), F.coalesce(main, F.lit(4)))
    if variant in ("arkansas_60", "arkansas_61"):
        return F.coalesce(main, F.when(code.between(1, int(variant[-2:])), F.lit(4)))
    raise ValueError(f"unknown variant: {variant}")


def clip_label(y: Column, n_classes: int) -> Column:
    """Limit a class to 0..n-1; an unknown class stays unknown."""
    return F.when(y.isNotNull(), F.least(F.greatest(y, F.lit(0)), F.lit(max(0, n_classes - 1))))


def eligible(code: Column, confidence: Column | None = None, land_cover: Column | None = None,
             min_confidence: float = 95.0, cropland: int = 40) -> Column:
    """Usable pixel: a crop code, enough confidence, and cropland once rounded."""
    keep = code != 0
    if confidence is not None:
        keep = keep & (confidence >= F.lit(float(min_confidence)))
    if land_cover is not None:
        keep = keep & (F.rint(land_cover).cast("int") == cropland)
    return keep


def argmax_class(proba: Column) -> Column:
    """First class of the largest probability."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def in_top(proba: Column, y: Column, k: int = 2) -> Column:
    """True class among the ``k`` best: fewer than ``k`` classes score higher."""
    own = F.get(proba, y)
    return F.size(F.filter(proba, lambda p: p > own)) < k


def class_name(y: Column, names: dict[int, str]) -> Column:
    """Name of a class for reports; ``Class 7`` for a class without one, null for a null class."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, y.cast("int")), F.concat(F.lit("Class "), y.cast("string")))
