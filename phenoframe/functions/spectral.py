"""Reflectance, spectral indices and simple covariate arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-6


def clip(x: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def reflectance(x: Column) -> Column:
    """Digital number to reflectance: scaled above 1.5, else limited to [0, 1]."""
    return F.when(x > F.lit(1.5), x / F.lit(10000.0)).otherwise(clip(x, 0.0, 1.0))


def ndvi(nir: Column, red: Column, variant: str = "epsilon") -> Column:
    """Vegetation index.

    ``epsilon`` adds 1e-6 below the line; ``zero`` is 0 where the sum is 0; ``clipped``
    works on reflectance, is 0 where the sum is at most 1e-6 and limited to [-1, 1].
    """
    if variant == "epsilon":
        return (nir - red) / (nir + red + F.lit(EPS))
    if variant == "zero":
        total = nir + red
        return F.when(total != 0, (nir - red) / total).when(total == 0, F.lit(0.0))
    if variant == "clipped":
        n, r = reflectance(nir), reflectance(red)
        total = n + r
        value = F.when(total > F.lit(EPS), (n - r) / total).when(total.isNotNull(), F.lit(0.0))
        return clip(value, -1.0, 1.0)
    raise ValueError(f"unknown variant: {variant}")


def ndwi(green: Column, nir: Column) -> Column:
    """Water index with 1e-6 below the line."""
    return (green - nir) / (green + nir + F.lit(EPS))


def append_indices(series: Column, bands: list[str], green: str, red: str, nir: str) -> Column:
    """Bands as reflectance, followed by the vegetation and the water index."""
    g, r, n = bands.index(green), bands.index(red), bands.index(nir)

    def widen(step: Column) -> Column:
        scaled = F.transform(step, reflectance)
        pick = [reflectance(F.get(step, F.lit(i))) for i in (g, r, n)]
        return F.concat(scaled, F.array(ndvi(pick[2], pick[1]), ndwi(pick[0], pick[2])))

    return F.transform(series, widen)


def silt(clay: Column, sand: Column) -> Column:
    """Silt share from clay and sand shares."""
    return F.lit(100) - clay - sand


def radar_ratio(vh: Column, vv: Column) -> Column:
    """Cross-polarisation ratio in dB."""
    return vh - vv
