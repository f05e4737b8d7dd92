import random
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from phenoframe.operators import cover
from phenoframe.operators.terrain import slope_aspect, tile_slope_aspect, with_halo
from phenoframe.sources.rasters import listed_scenes, scene_observations, write_scene_rasters

GEOMETRY = "tile_id string, x0 double, y0 double, dx double, dy double, n_rows int, n_cols int"


def brute_places(points, tiles):
    out = []
    for i, x, y in points:
        found = []
        for name, x0, y0, dx, dy, rows, cols in tiles:
            if x is not None and y is not None:
                r, c = (y - y0) // dy, (x - x0) // dx
                if 0 <= r < rows and 0 <= c < cols:
                    found.append((i, name, int(r), int(c)))
        out += found or [(i, None, None, None)]
    return sorted(out, key=str)


def test_points_meet_tiles_of_any_size(spark):
    rng = random.Random(3)
    tiles = [(f"t{i}", rng.uniform(-500, 500), rng.uniform(-500, 500), 2.0 ** rng.randrange(-6, 7), -(2.0 ** rng.randrange(-6, 7)), rng.randrange(1, 9), rng.randrange(1, 9)) for i in range(150)]
    tiles += [("wide", -4096.0, -4096.0, 8.0, 8.0, 1024, 1024), ("line", -500.0, 0.0, 1000.0, 0.001, 1, 1)]
    points = [(i, rng.uniform(-600, 600), rng.uniform(-600, 600)) for i in range(400)] + [(900, None, 1.0), (901, 1.0, None), (902, 1e9, 1e9), (903, 5.0, 0.0005), (903, 5.0, 0.0005)]
    p = spark.createDataFrame(points, "id int, x double, y double")
    t = spark.createDataFrame(tiles, GEOMETRY)
    got = sorted((tuple(r) for r in cover.points_in_tiles(p, t, x="x", y="y").select("id", "tile_id", "row", "col").collect()), key=str)
    assert got == brute_places(points, tiles)
    assert cover.points_in_tiles(p, t.where("false"), x="x", y="y").where("tile_id is not null").count() == 0


def test_a_mosaic_does_not_widen_the_cells_of_small_tiles(spark):
    tiles = [(f"t{i}", i % 20 * 50.0, i // 20 * 50.0, 5.0, 5.0, 10, 10) for i in range(400)] + [("mosaic", 0.0, 0.0, 1.0, 1.0, 4096, 4096)]
    spread = cover.tile_cover(spark.createDataFrame(tiles, GEOMETRY))
    load = spread.groupBy("_level", "_cx", "_cy").count().agg(F.max("count")).first()[0]
    assert load <= 9 and spread.count() <= 4 * 401


def test_slopes_do_not_depend_on_the_tiling(spark):
    rng = random.Random(4)
    z = {(r, c): rng.uniform(0, 900) for r in range(13) for c in range(17) if (r, c) != (5, 5)}
    whole = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, elevation double")
    want = {(r["row"], r["col"]): (r["slope"], r["aspect"]) for r in slope_aspect(whole, dx=30.0, dy=30.0).collect()}
    cuts = [("a", 0, 0, 6, 9), ("b", 0, 9, 6, 8), ("c", 6, 0, 7, 9), ("d", 6, 9, 7, 8)]
    tiles = spark.createDataFrame([(n, 100.0 + c * 30, 700.0 - r * 30, 30.0, -30.0, h, w) for n, r, c, h, w in cuts], GEOMETRY)
    rows = [(n, r - r0, c - c0, v) for n, r0, c0, h, w in cuts for (r, c), v in z.items() if r0 <= r < r0 + h and c0 <= c < c0 + w]
    dem = spark.createDataFrame(rows, "tile_id string, row int, col int, elevation double")
    at = {n: (r, c) for n, r, c, _, _ in cuts}
    got = {(at[r["tile_id"]][0] + r["row"], at[r["tile_id"]][1] + r["col"]): (r["slope"], r["aspect"]) for r in tile_slope_aspect(dem, tiles, dx=30.0, dy=30.0).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (pytest.approx(v) if v[0] is not None else v)
    assert sum(v[0] is not None for v in want.values()) == 11 * 15 - 9
    halo = with_halo(dem, tiles).where("halo").groupBy("tile_id").count().collect()
    assert {r["tile_id"]: r["count"] for r in halo} == {"a": 16, "b": 15, "c": 17 - 1, "d": 16}  # a lacks a border cell


TILES = [("t1", 0.0, 0.0, 1.0, 1.0, 4, 4), ("t2", 2.0, 0.0, 1.0, 1.0, 4, 4), ("t3", 90.0, 0.0, 1.0, 1.0, 4, 4)]


@pytest.fixture()
def store(spark, tmp_path):
    rows = [
        (s, b, t, r, c, float(100 * n + 10 * r + c if (r, c) != (1, 1) else -1))
        for n, s in enumerate(["S1", "S2", "S3", "S4"]) for b in ("B04", "B08") for t, *_ in TILES for r in range(4) for c in range(4) if (s, t) != ("S2", "t1")
    ]
    path = f"{tmp_path}/rasters"
    write_scene_rasters(spark.createDataFrame(rows, "scene string, band string, tile_id string, row int, col int, value double"), path)
    scenes = spark.createDataFrame(
        [("/x/S1.SAFE", date(2021, 5, 1)), ("/x/S2", date(2021, 6, 1)), ("/x/S2", date(2021, 6, 1)), ("/x/S3", date(2022, 1, 1))], "scene_path string, acq_date date"
    )
    catalog = spark.createDataFrame([(s, b) for s in ("S1", "S2", "S3", "S4") for b in ("B04", "B08")], "scene string, band string")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.5, 1.5), (3, 1.5, 1.5), (4, 50.0, 50.0), (5, None, 1.0)], "id int, x double, y double")
    return path, points, scenes, catalog, spark.createDataFrame(TILES, GEOMETRY)


YEAR = {"start": date(2021, 1, 1), "end": date(2022, 1, 1)}


def test_observations_of_listed_scenes(spark, store):
    path, points, scenes, catalog, tiles = store
    got = scene_observations(points, scenes, catalog, spark.read.parquet(path), tiles, ["B08", "B04"], nodata=-1.0, **YEAR)
    assert got.columns == ["id", "obs_date", "scene", "B08", "B04"]
    s1, s2 = (date(2021, 5, 1), "S1"), (date(2021, 6, 1), "S2")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(
        [(1, *s1, 0.0, 0.0), (2, *s1, 12.0, 12.0), (2, *s2, 110.0, 110.0), (3, *s1, None, None)], key=str
    )


def test_only_listed_folders_are_read(spark, store):
    path, points, scenes, catalog, tiles = store
    for folder in Path(path).glob("scene=*/band=*/tile_id=*"):
        unlisted = any(part in str(folder) for part in ("scene=S3", "scene=S4", "tile_id=t3", "band=B08"))
        for file in folder.glob("*.parquet") if unlisted else []:
            file.write_bytes(b"not a parquet file")
            (folder / f".{file.name}.crc").unlink(missing_ok=True)
    schema = "row int, col int, value double, scene string, band string, tile_id string"
    rasters = spark.read.schema(schema).parquet(path)
    got = scene_observations(points, scenes, catalog, rasters, tiles, ["B04"], nodata=-1.0, **YEAR)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 4
    with pytest.raises(Exception, match="parquet"):
        rasters.agg(F.sum("value")).collect()


def test_scenes_without_bands_are_an_error(spark, store):
    path, points, scenes, catalog, tiles = store
    with pytest.raises(KeyError, match="S1 lacks band B11"):
        scene_observations(points, scenes.limit(1), catalog, spark.read.parquet(path), tiles, ["B04", "B11"], **YEAR)
    with pytest.raises(KeyError, match="S2 has no band files"):
        scene_observations(points, scenes, catalog.where("scene <> 'S2'"), spark.read.parquet(path), tiles, ["B04"], **YEAR)
    none = scene_observations(points, scenes.where("false"), catalog, spark.read.parquet(path), tiles, ["B04"], **YEAR)
    assert none.collect() == [] and listed_scenes(scenes, **YEAR).count() == 2
