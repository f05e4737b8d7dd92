"""Points, grid cells and areas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

POINT = "type STRING, coordinates ARRAY<DOUBLE>"


def parse_point(text: Column) -> Column:
    """GeoJSON point text as ``struct<lon,lat>``; an error for anything else."""
    parsed = F.from_json(text, POINT)
    coords = parsed["coordinates"]
    good = (parsed["type"] == "Point") & (F.size(coords) >= 2)
    lon = F.when(good, coords[0]).otherwise(
        F.raise_error(F.concat(F.lit("not a GeoJSON point: "), F.coalesce(text, F.lit("null")))).cast(
            "double"
        )
    )
    return F.struct(lon.alias("lon"), F.get(coords, F.lit(1)).alias("lat"))


def row_of(index: Column, width: int) -> Column:
    """Row of a flat raster index."""
    return F.floor(index / F.lit(width)).cast("bigint")


def col_of(index: Column, width: int) -> Column:
    """Column of a flat raster index."""
    return F.pmod(index, F.lit(width)).cast("bigint")


def centre(number: Column, origin: float, step: float) -> Column:
    """Coordinate of a cell centre along one axis."""
    return F.lit(float(origin)) + (number + F.lit(0.5)) * F.lit(float(step))


def cell(coordinate: Column, origin: float, step: float) -> Column:
    """Cell that holds a coordinate along one axis."""
    return F.floor((coordinate - F.lit(float(origin))) / F.lit(float(step))).cast("bigint")


def within(lon: Column, lat: Column, areas: list[tuple[float, float, float, float]]) -> Column:
    """Inside any of the rectangles (west, south, east, north)."""
    inside = [
        lon.between(west, east) & lat.between(south, north) for west, south, east, north in areas
    ]
    return reduce(lambda a, b: a | b, inside)


def buffer_bounds(lon: float, lat: float, metres: float) -> tuple[float, float, float, float]:
    """Bounding rectangle of a point buffered by a distance on the sphere."""
    from math import cos, degrees, radians

    radius = 6_371_008.8
    dy = degrees(metres / radius)
    dx = dy / cos(radians(lat))
    return (lon - dx, lat - dy, lon + dx, lat + dy)
