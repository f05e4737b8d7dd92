"""Scene rasters as a table of partitions, and the observations of points in them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from phenoframe.functions.masks import nodata_to_null
from phenoframe.operators.cover import points_in_tiles
from phenoframe.scale.bounds import materialised
from phenoframe.sources.scenes import require_bands

LAYOUT = ["scene", "band", "tile_id"]
LISTED_TILES = 10_000  # tiles named in a filter on folders; more are found by a join


def write_scene_rasters(rasters: DataFrame, path: str) -> None:
    """Write ``(scene, band, tile_id, row, col, value)`` with a folder per scene, band and tile."""
    rasters.repartition(*LAYOUT).write.partitionBy(*LAYOUT).parquet(path)


def listed_scenes(scenes: DataFrame, start: date, end: date) -> DataFrame:
    """``(scene, acq_date)`` of listed scene paths acquired from ``start`` up to before ``end``."""
    name = F.regexp_replace(F.element_at(F.split("scene_path", "/"), -1), r"\.SAFE$", "")
    dates = scenes.select(name.alias("scene"), "acq_date").where((F.col("acq_date") >= F.lit(start)) & (F.col("acq_date") < F.lit(end)))
    return dates.groupBy("scene").agg(F.min("acq_date").alias("acq_date"))


def scene_observations(
    points: DataFrame, scenes: DataFrame, catalog: DataFrame, rasters: DataFrame, tiles: DataFrame, bands: list[str], *,
    start: date, end: date, nodata: float | None = None, id_col: str = "id", x: str = "x", y: str = "y",
) -> DataFrame:
    """``(id, obs_date, scene, <bands>)``: what the listed scenes show at the points.

    ``scenes`` are ``(scene_path, acq_date)``, ``catalog`` the band files of scenes; a listed
    scene without one of ``bands`` is an error. ``rasters`` is the table that
    ``write_scene_rasters`` wrote: the scenes of the list, the bands and the tiles that hold points
    are the only folders read, by dynamic pruning on the list. Of overlapping tiles of a scene that of the smallest id is taken.
    The nodata value is null; points outside a scene have no row for it. Ids must be unique.
    """
    listed = materialised(listed_scenes(scenes, start, end))
    require_bands(catalog.join(listed.select("scene"), "scene", "left_semi"), bands)
    uncatalogued = listed.join(catalog.select("scene"), "scene", "left_anti").limit(1).collect()
    if uncatalogued:
        raise KeyError(f"scene {uncatalogued[0]['scene']} has no band files")
    located = points_in_tiles(points.select(F.col(id_col).alias("id"), x, y), tiles, x=x, y=y)
    located = materialised(located.where(F.col("tile_id").isNotNull()).select("id", "tile_id", "row", "col"))
    held = located.select("tile_id").distinct()
    cells = located.select("tile_id", "row", "col").distinct()
    names = [r["tile_id"] for r in held.limit(LISTED_TILES + 1).collect()]
    of_tiles = rasters.where(F.col("tile_id").isin(names)) if len(names) <= LISTED_TILES else rasters.join(held, "tile_id", "left_semi")
    picked = (
        of_tiles.where(F.col("band").isin(bands))
        .join(listed.where((F.col("acq_date") >= F.lit(start)) & (F.col("acq_date") < F.lit(end))), "scene")
        .join(cells, ["tile_id", "row", "col"], "left_semi")
    )
    value = F.col("value") if nodata is None else nodata_to_null(F.col("value"), nodata)
    by_band = [F.max(F.when(F.col("band") == b, value)).alias(b) for b in bands]
    seen = picked.groupBy("tile_id", "row", "col", "scene").agg(F.first("acq_date").alias("obs_date"), *by_band)
    every = located.join(seen, ["tile_id", "row", "col"])
    first = every.groupBy("id", "scene").agg(F.min_by(F.struct("obs_date", *bands), "tile_id").alias("_o"))
    return first.select(F.col("id").alias(id_col), "_o.obs_date", "scene", *[f"_o.{b}" for b in bands])
