"""Scenes to observations, tiles of mixed size, terrain across tile borders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from phenoframe.functions.geo import col_of, row_of
from phenoframe.operators import align
from phenoframe.operators.terrain import tile_slope_aspect
from phenoframe.registry.base import query, rounded
from phenoframe.registry.roles import table
from phenoframe.scale.bounds import new_folder
from phenoframe.sources.rasters import scene_observations, write_scene_rasters
from phenoframe.sources.scenes import band_catalog, scene_lines

# Parts as cells of two overlapping tiles, seen by four scenes of which three are listed and two
# lie in the year; customers as points.
SCENES = [("20210601", 1.0), ("20210715", 0.5), ("20220105", 2.0), ("20210801", 3.0)]
SCENE_TILES = [("east", 400.0, 0.0, 20.0, 40.0, 25, 30), ("west", 0.0, 1000.0, 10.0, -40.0, 25, 50)]
SCENE_POINTS = "SELECT c_custkey AS id, CAST(c_custkey * 7 % 1100 AS DOUBLE) AS x, CAST(c_custkey * 13 % 1050 AS DOUBLE) AS y FROM customer"


def scene_name(day: str) -> str:
    return f"S2A_MSIL2A_{day}T162901"


@query("scene_observations", f"""
WITH tiles(tile_id, x0, y0, dx, dy, n_rows, n_cols) AS (VALUES {', '.join(map(str, SCENE_TILES))}),
scenes(scene, obs_date, factor) AS (VALUES {', '.join(f"('{scene_name(d)}', DATE '{d[:4]}-{d[4:6]}-{d[6:]}', {f})" for d, f in SCENES[:2])}),
cells AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'east' ELSE 'west' END AS tile_id, (p_partkey // 2) // 40 AS row, (p_partkey // 2) % 40 AS col,
         p_retailprice AS price, p_size AS size FROM part),
pts AS ({SCENE_POINTS}),
placed AS (
  SELECT id, tile_id, CAST(floor((y - y0) / dy) AS BIGINT) AS row, CAST(floor((x - x0) / dx) AS BIGINT) AS col FROM pts JOIN tiles
  ON floor((y - y0) / dy) >= 0 AND floor((y - y0) / dy) < n_rows AND floor((x - x0) / dx) >= 0 AND floor((x - x0) / dx) < n_cols),
seen AS (SELECT id, scene, tile_id, obs_date, price * factor AS B04, NULLIF(CAST(size AS DOUBLE) * factor, 5) AS B08 FROM placed JOIN cells USING (tile_id, row, col), scenes)
SELECT id, obs_date, scene, B04, B08 FROM seen QUALIFY row_number() OVER (PARTITION BY id, scene ORDER BY tile_id) = 1
""")
def observations_of_scenes(spark, sf):
    """Catalog, rasters by scene, band and tile, and points joined to observations."""
    key = F.expr("p_partkey div 2")
    cells = table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, "east").otherwise("west").alias("tile_id"),
        row_of(key, 40).alias("row"), col_of(key, 40).alias("col"), "p_retailprice", "p_size",
    )
    seen = F.explode(F.array(*[
        F.struct(F.lit(scene_name(day)).alias("scene"), F.lit(band).alias("band"), (F.col(source) * F.lit(factor)).alias("value"))
        for day, factor in SCENES for band, source in (("B04", "p_retailprice"), ("B08", "p_size"), ("B11", "p_size"))
    ]))
    path = new_folder(spark, "rasters")
    write_scene_rasters(cells.select("tile_id", "row", "col", seen.alias("s")).select("s.*", "tile_id", "row", "col"), path)
    rasters = spark.read.parquet(path)

    found = rasters.select("scene", "band").distinct()
    files = found.select(F.format_string("/data/%s.SAFE/GRANULE/L2A_T15/IMG_DATA/R10m/T15_%s_10m.jp2", "scene", "band").alias("file_path"))
    catalog = band_catalog(files).withColumn("scene", F.regexp_replace("scene", r"\.SAFE$", ""))
    listed = [f"/data/{scene_name(day)}.SAFE" for day, _ in SCENES[:3]] + ["# all of one year", ""]
    scenes = scene_lines(spark.createDataFrame([(line,) for line in listed], "value string"))
    tiles = spark.createDataFrame(SCENE_TILES, "tile_id string, x0 double, y0 double, dx double, dy double, n_rows int, n_cols int")
    custkey = F.col("c_custkey")
    points = table(spark, sf, "customer").select(
        custkey.alias("id"), (custkey * 7 % 1100).cast("double").alias("x"), (custkey * 13 % 1050).cast("double").alias("y")
    )
    return scene_observations(
        points, scenes, catalog, rasters, tiles, ["B04", "B08"], start=date(2021, 1, 1), end=date(2022, 1, 1), nodata=5.0
    )


# Four hundred small tiles side by side, and a mosaic and a strip above them all.
@query("mixed_tile_join", f"""
WITH small AS (SELECT 't' || i AS tile_id, (i % 20) * 50.0 AS x0, (i // 20) * 50.0 AS y0, 5.0 AS dx, 5.0 AS dy, 10 AS n_rows, 10 AS n_cols FROM (SELECT unnest(range(400)) AS i)),
tiles AS (SELECT * FROM small UNION ALL VALUES ('mosaic', 0.0, 4096.0, 1.0, -1.0, 4096, 4096), ('strip', 100.0, 500.0, 2.0, 0.5, 3, 300)),
pts AS (SELECT o_orderkey AS id, CAST(o_orderkey * 7 % 1203 AS DOUBLE) - 3 AS x, CAST(o_orderkey * 11 % 4300 AS DOUBLE) AS y FROM orders),
placed AS (
  SELECT id, tile_id, CAST(floor((y - y0) / dy) AS BIGINT) AS row, CAST(floor((x - x0) / dx) AS BIGINT) AS col FROM pts JOIN tiles
  ON floor((y - y0) / dy) >= 0 AND floor((y - y0) / dy) < n_rows AND floor((x - x0) / dx) >= 0 AND floor((x - x0) / dx) < n_cols)
SELECT id, tile_id, row, col FROM (SELECT id FROM pts) LEFT JOIN placed USING (id)
""")
def mixed_tile_join(spark, sf):
    """Points in small tiles, a wide mosaic and a strip at once."""
    i = F.col("id").cast("int")
    small = spark.range(400).select(
        F.concat(F.lit("t"), i.cast("string")).alias("tile_id"), ((i % 20) * 50.0).alias("x0"), (F.floor(i / 20) * 50.0).alias("y0"),
        F.lit(5.0).alias("dx"), F.lit(5.0).alias("dy"), F.lit(10).alias("n_rows"), F.lit(10).alias("n_cols"),
    )
    wide = spark.createDataFrame([("mosaic", 0.0, 4096.0, 1.0, -1.0, 4096, 4096), ("strip", 100.0, 500.0, 2.0, 0.5, 3, 300)], small.schema)
    key = F.col("o_orderkey")
    points = table(spark, sf, "orders").select(
        key.alias("id"), ((key * 7 % 1203).cast("double") - 3).alias("x"), (key * 11 % 4300).cast("double").alias("y")
    )
    return align.points_in_tiles(points, small.unionByName(wide), x="x", y="y").select("id", "tile_id", "row", "col")


# Parts as one grid of 40 columns, cut into tiles of 16 columns and 8 rows.
@query("halo_terrain", """
WITH g AS (SELECT p_partkey // 40 AS row, p_partkey % 40 AS col, p_retailprice * (1 + p_size % 7) AS z FROM part),
n AS (SELECT g.row, g.col, h.row - g.row AS dr, h.col - g.col AS dc, h.z FROM g JOIN g h ON abs(h.row - g.row) <= 1 AND abs(h.col - g.col) <= 1),
s AS (SELECT row, col, count(*) AS k, sum(z * dc * (2 - abs(dr))) / 80 AS gx, sum(z * dr * (2 - abs(dc))) / 80 AS gy FROM n GROUP BY ALL)
SELECT (row // 8) || '-' || (col // 16) AS tile_id, row % 8 AS row, col % 16 AS col, round(CASE WHEN k = 9 THEN degrees(atan(sqrt(gx * gx + gy * gy))) END, 4) + CAST(0 AS DOUBLE) AS slope,
  round(CASE WHEN k = 9 THEN CASE WHEN degrees(atan2(-gx, gy)) < 0 THEN degrees(atan2(-gx, gy)) + 360 ELSE degrees(atan2(-gx, gy)) END END, 4) + CAST(0 AS DOUBLE) AS aspect
FROM s""")
def halo_terrain(spark, sf):
    """A grid in tiles has the slopes of the whole grid."""
    row, col = row_of(F.col("p_partkey"), 40), col_of(F.col("p_partkey"), 40)
    down, across = F.floor(row / 8).cast("bigint"), F.floor(col / 16).cast("bigint")
    cells = table(spark, sf, "part").select(
        F.concat_ws("-", down.cast("string"), across.cast("string")).alias("tile_id"), (row % 8).alias("row"), (col % 16).alias("col"),
        (F.col("p_retailprice") * (1 + F.col("p_size") % 7)).alias("elevation"), down.alias("down"), across.alias("across"),
    )
    tiles = cells.groupBy("tile_id").agg(F.first("down").alias("down"), F.first("across").alias("across")).select(
        "tile_id", (F.col("across") * 160.0).alias("x0"), (F.col("down") * -80.0).alias("y0"), F.lit(10.0).alias("dx"), F.lit(-10.0).alias("dy"),
        F.lit(8).alias("n_rows"), F.when(F.col("across") == 2, 8).otherwise(16).alias("n_cols"),
    )
    return rounded(tile_slope_aspect(cells, tiles, dx=10.0, dy=10.0), ["slope", "aspect"], 4)
