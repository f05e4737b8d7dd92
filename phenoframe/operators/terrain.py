"""Slope and aspect of an elevation grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenoframe.operators.cover import points_in_tiles

# Horn's 3x3 weights as (row offset, column offset, east-west, north-south).
HORN = [
    (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1),
    (0, -1, -2, 0), (0, 0, 0, 0), (0, 1, 2, 0),
    (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1),
]


def slope_aspect(
    dem: DataFrame, elevation: str = "elevation", row: str = "row", col: str = "col",
    dx: float = 1.0, dy: float = 1.0, tile: str | None = None, halo: str | None = None,
) -> DataFrame:
    """Slope and aspect in degrees; null where a neighbour is missing.

    Rows run south. Every cell sends its weighted height to its neighbours, which sum what
    they receive: one grouped pass with partial sums, no self-joins. Aspect is the direction
    the slope faces, clockwise from north. With ``tile`` each tile is a grid of its own;
    cells marked by the column ``halo`` are neighbours from other tiles and have no result.
    """
    mine = F.lit(1) if halo is None else F.when(F.col(halo), 0).otherwise(1)
    tiles = [] if tile is None else [tile]
    targets = F.array(
        *[
            F.struct(
                (F.col(row) - dr).alias("row"),
                (F.col(col) - dc).alias("col"),
                (F.col(elevation) * wx).alias("x"),
                (F.col(elevation) * wy).alias("y"),
                (mine if (dr, dc) == (0, 0) else F.lit(0)).alias("own"),
            )
            for dr, dc, wx, wy in HORN
        ]
    )
    sums = (
        dem.where(F.col(elevation).isNotNull())
        .select(*tiles, F.explode(targets).alias("n"))
        .select(*tiles, "n.*")
        .groupBy(*tiles, "row", "col")
        .agg(
            F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("own").alias("own"),
            F.count(F.lit(1)).alias("n"),
        )
        .where(F.col("own") > 0)
    )
    full = F.col("n") == 9
    gx, gy = F.col("x") / (8 * dx), F.col("y") / (8 * dy)
    slope = F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))
    facing = F.pmod(F.degrees(F.atan2(-gx, gy)) + 360, F.lit(360.0))
    return sums.select(
        *tiles,
        F.col("row").alias(row),
        F.col("col").alias(col),
        F.when(full, slope).alias("slope"),
        F.when(full, facing).alias("aspect"),
    )


def with_halo(dem: DataFrame, tiles: DataFrame, elevation: str = "elevation") -> DataFrame:
    """``(tile_id, row, col, elevation, halo)``: all cells, and the cells that border each tile.

    Tiles ``(tile_id, x0, y0, dx, dy, n_rows, n_cols)`` that meet share one lattice. A border
    cell is placed in world coordinates in the tiles that hold its outer neighbours, and sent there
    once; inner cells do not move. Where several tiles hold a cell, that of the smallest id is sent.
    """
    known = dem.select("tile_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), elevation)
    border = known.join(tiles, "tile_id").where(
        (F.col("row") == 0) | (F.col("row") == F.col("n_rows") - 1) | (F.col("col") == 0) | (F.col("col") == F.col("n_cols") - 1)
    )
    around = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc, *_ in HORN if (dr, dc) != (0, 0)])
    out = border.select("*", F.explode(around).alias("n")).select(
        F.col("tile_id").alias("from_tile"), elevation, "n.dr", "n.dc",
        (F.col("row") + F.col("n.dr")).alias("_r"), (F.col("col") + F.col("n.dc")).alias("_c"), "n_rows", "n_cols", "x0", "y0", "dx", "dy",
    )
    out = out.where(~(F.col("_r").between(0, F.col("n_rows") - 1) & F.col("_c").between(0, F.col("n_cols") - 1)))
    places = out.select(
        "from_tile", elevation, "dr", "dc",
        (F.col("x0") + (F.col("_c") + F.lit(0.5)) * F.col("dx")).alias("_wx"),
        (F.col("y0") + (F.col("_r") + F.lit(0.5)) * F.col("dy")).alias("_wy"),
    )
    met = points_in_tiles(places, tiles, x="_wx", y="_wy").where(F.col("tile_id").isNotNull() & (F.col("tile_id") != F.col("from_tile")))
    sizes = tiles.select("tile_id", "n_rows", "n_cols")
    sent = met.select("tile_id", "from_tile", (F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), elevation).join(sizes, "tile_id")
    sent = sent.where(~(F.col("row").between(0, F.col("n_rows") - 1) & F.col("col").between(0, F.col("n_cols") - 1)))
    once = sent.groupBy("tile_id", "row", "col").agg(F.min_by(elevation, "from_tile").alias(elevation))
    return known.withColumn("halo", F.lit(False)).unionByName(once.withColumn("halo", F.lit(True)))


def tile_slope_aspect(dem: DataFrame, tiles: DataFrame, elevation: str = "elevation", dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Slope and aspect of a tiled grid as if it were one; null only at the edge of all tiles."""
    return slope_aspect(with_halo(dem, tiles, elevation), elevation, dx=dx, dy=dy, tile="tile_id", halo="halo")
