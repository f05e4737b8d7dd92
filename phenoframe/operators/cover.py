"""Points and the tiles that hold them, for tiles of any mix of sizes.

Each tile lies on the cells of one level of a quadtree, whose cells are as wide as the next
power of two above the tile. Points look for tiles in the cells that hold them at the levels
that occur, so a wide tile does not draw the points of small ones to its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.scale.bounds import materialised, small_table

HOT_CELLS = 2000  # cells with more than this share of all lookups are met by broadcast


def tile_bounds(tiles: DataFrame) -> DataFrame:
    """Bounds of tiles given as ``(tile_id, x0, y0, dx, dy, n_rows, n_cols)``; steps may be negative."""
    x1, y1 = F.col("x0") + F.col("dx") * F.col("n_cols"), F.col("y0") + F.col("dy") * F.col("n_rows")
    return tiles.select(
        "tile_id", "x0", "y0", "dx", "dy", "n_rows", "n_cols",
        F.least("x0", x1).alias("west"), F.greatest("x0", x1).alias("east"),
        F.least("y0", y1).alias("south"), F.greatest("y0", y1).alias("north"),
    )


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("bigint")


def tile_cover(tiles: DataFrame) -> DataFrame:
    """Tiles once per quadtree cell ``(_level, _cx, _cy)`` they touch, four cells as a rule."""
    bounds = tile_bounds(tiles)
    extent = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    bounds = bounds.where(extent > 0).withColumn("_level", F.ceil(F.log2(extent)).cast("int"))
    level = F.col("_level")
    spread = bounds.withColumn("_cx", F.explode(F.sequence(_cell(F.col("west"), level), _cell(F.col("east"), level))))
    return spread.withColumn("_cy", F.explode(F.sequence(_cell(F.col("south"), level), _cell(F.col("north"), level))))


def _meet(lookups: DataFrame, cover: DataFrame) -> DataFrame:
    """Inner join of lookups and tiles on their cells.

    Cells with more than a 2,000th of the lookups are fewer than 2,000. Their tiles become a
    local relation when at most 10,000, and those lookups stay where they are; the rest is
    joined by cell.
    """
    keys = ["_level", "_cx", "_cy"]
    loads = materialised(lookups.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(cover.select(*keys).distinct(), keys))
    total = loads.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(small_table(loads.where(F.col("_n") > total // HOT_CELLS).select(*keys), HOT_CELLS))
    busy = small_table(cover.join(hot, keys, "left_semi"))
    calm = loads.where(F.col("_n") <= total // HOT_CELLS).select(*keys)
    return lookups.join(busy, keys).unionByName(lookups.join(hot, keys, "left_anti").join(cover.join(calm, keys, "left_semi"), keys))


def points_in_tiles(points: DataFrame, tiles: DataFrame, *, x: str, y: str) -> DataFrame:
    """Points with the tile, row and column that hold them, null outside all tiles.

    A point in several overlapping tiles gives a row for each of them. Points without a
    coordinate are in no tile. Each point is looked up once per level, and there are as many
    levels as tile sizes by powers of two.
    """
    cover = materialised(tile_cover(tiles))
    levels = sorted(r["_level"] for r in cover.select("_level").distinct().collect())
    row = F.floor((F.col("_y") - F.col("y0")) / F.col("dy")).cast("bigint")
    col = F.floor((F.col("_x") - F.col("x0")) / F.col("dx")).cast("bigint")
    keyed = materialised(points.withColumn("_p", F.monotonically_increasing_id()))
    known = keyed.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = known.select("_p", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    lookups = at.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    lookups = lookups.withColumn("_cx", _cell(F.col("_x"), F.col("_level"))).withColumn("_cy", _cell(F.col("_y"), F.col("_level")))
    found = _meet(lookups, cover).select("_p", "tile_id", row.alias("row"), col.alias("col"), "n_rows", "n_cols")
    inside = (F.col("row") >= 0) & (F.col("row") < F.col("n_rows")) & (F.col("col") >= 0) & (F.col("col") < F.col("n_cols"))
    places = found.where(inside).drop("n_rows", "n_cols")
    return keyed.join(places, "_p", "left").select(*points.columns, "tile_id", "row", "col")
