"""Code mappings, joins across modalities and raster cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.functions.geo import col_of, row_of
from phenoframe.functions.labels import code_class
from phenoframe.operators import align
from phenoframe.operators.composite import climate_aggregate, monthly_radar, radar_columns
from phenoframe.operators.labels import dense_codes, lookup_class, remap_dense
from phenoframe.registry.base import query, r, rounded, sr
from phenoframe.registry.roles import (
    COMP, OBS, PIXEL, composites, observations, pixels, points, table, with_ctes,
)


@query("label_remap_fixed", """
SELECT l_partkey * 7 + l_linenumber AS id, CAST(any_value(code) AS BIGINT) AS code,
  CAST(any_value(CASE code WHEN 69 THEN 0 WHEN 3 THEN 1 WHEN 36 THEN 2 WHEN 75 THEN 3 WHEN 204 THEN 4 ELSE 5 END) AS INT) AS california,
  CAST(any_value(CASE code WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 5 THEN 2 WHEN 3 THEN 3 ELSE 4 END) AS INT) AS arkansas,
  CAST(any_value(CASE code WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 5 THEN 2 WHEN 3 THEN 3 ELSE CASE WHEN code BETWEEN 1 AND 60 THEN 4 END END) AS INT) AS arkansas_60,
  CAST(any_value(CASE code WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 5 THEN 2 WHEN 3 THEN 3 ELSE CASE WHEN code BETWEEN 1 AND 61 THEN 4 END END) AS INT) AS arkansas_61
FROM (SELECT l_partkey, l_linenumber, (l_partkey * 7 + l_linenumber) % 256 AS code FROM lineitem) GROUP BY 1
""")
def label_remap_fixed(spark, sf):
    key = F.col("l_partkey") * 7 + F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select(key.alias("id"), (key % 256).alias("code"))
    variants = ["california", "arkansas", "arkansas_60", "arkansas_61"]
    # Duplicate ids carry the same code, so the group is a distinct.
    return rows.distinct().select("id", "code", *[code_class(F.col("code"), v).alias(v) for v in variants])


@query("label_remap_dense", """
WITH codes AS (SELECT p_size AS code, dense_rank() OVER (ORDER BY p_size) - 1 AS class_id
  FROM (SELECT DISTINCT p_size FROM part WHERE p_size NOT IN (1, 7)))
SELECT p_partkey AS pixel_id, p_size AS code, class_id FROM part LEFT JOIN codes ON p_size = code
""")
def label_remap_dense(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("pixel_id"), F.col("p_size").alias("code"))
    return remap_dense(rows, "code", dense_codes(rows, "code", ignore=[1, 7]))


@query("code_lookup", """
SELECT s_suppkey AS pixel_id, s_nationkey AS code, COALESCE(n_regionkey, -1) AS class_id
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey
""")
def code_lookup(spark, sf):
    mapping = table(spark, sf, "nation").where("n_regionkey <> 2").select(
        F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("class_id")
    )
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pixel_id"), F.col("s_nationkey").alias("code"))
    return lookup_class(rows, "code", mapping, "class_id")


@query("code_lookup_known", """
SELECT s_suppkey AS pixel_id, s_nationkey AS code, n_regionkey AS class_id
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2
""")
def code_lookup_known(spark, sf):
    mapping = table(spark, sf, "nation").where("n_regionkey <> 2").select(
        F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("class_id")
    )
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pixel_id"), F.col("s_nationkey").alias("code"))
    return lookup_class(rows, "code", mapping, "class_id", drop_unknown=True)


RASTER = """raster AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, p_size AS code, p_retailprice AS elevation FROM part)"""


def raster(spark, sf):
    idx = F.col("p_partkey")
    return table(spark, sf, "part").select(
        row_of(idx, 50).alias("row"), col_of(idx, 50).alias("col"),
        F.col("p_size").alias("code"), F.col("p_retailprice").alias("elevation"),
    )


@query("cell_sample_join", with_ctes(RASTER, body="""
SELECT o_orderkey AS id, code, elevation FROM orders
LEFT JOIN raster ON col = CAST(floor((o_totalprice - 1000) / 10000) AS BIGINT) AND row = CAST(floor((o_custkey - 3) / 40.0) AS BIGINT)"""))
def cell_sample(spark, sf):
    located = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y")
    )
    out = align.sample_cells(located, raster(spark, sf), x="x", y="y", origin=(1000.0, 3.0), step=(10000.0, 40.0))
    return out.select("id", "code", "elevation")


@query("nearest_grid_align", with_ctes(RASTER, body="""
SELECT c_custkey // 40 AS row, c_custkey % 40 AS col, c_nationkey AS label, code, elevation FROM customer
LEFT JOIN raster r ON r.col = CAST(floor((100 + (c_custkey % 40 + 0.5) * 30 - 90) / 25) AS BIGINT)
  AND r.row = CAST(floor((900 + (c_custkey // 40 + 0.5) * -20 - 910) / -15) AS BIGINT)"""))
def nearest_grid(spark, sf):
    idx = F.col("c_custkey")
    target = table(spark, sf, "customer").select(
        row_of(idx, 40).alias("row"), col_of(idx, 40).alias("col"), F.col("c_nationkey").alias("label")
    )
    return align.align_nearest(
        target, raster(spark, sf), target_origin=(100, 900), target_step=(30, -20),
        source_origin=(90, 910), source_step=(25, -15), values=["code", "elevation"],
    )


def radar_obs(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("day"),
        (-F.col("o_totalprice") / 20000).alias("vh"), (-F.col("o_totalprice") / 30000).alias("vv"),
    )


MONTHS = """radar AS (SELECT o_custkey AS id, o_orderdate AS day, -o_totalprice / 20000 AS vh, -o_totalprice / 30000 AS vv FROM orders),
yearly AS (SELECT id, avg(vh) AS vh, avg(vv) AS vv FROM radar {where} GROUP BY id),
monthly AS (SELECT id, CAST(month(day) AS INT) AS month, avg(vh) AS vh, avg(vv) AS vv FROM radar {where} GROUP BY ALL),
grid AS (SELECT *, CAST(unnest(range(1, 13)) AS INT) AS month FROM yearly)"""


def radar_long(wide):
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("month"), *[F.col(f"{c}_{m:02d}").alias(c) for c in ("ratio", "vh", "vv")])
            for m in range(1, 13)
        ]
    )
    return rounded(wide.select("id", F.explode(entries).alias("e")).select("id", "e.*"), ["ratio", "vh", "vv"], 12)


@query("monthly_fallback", with_ctes(MONTHS.format(where="WHERE day >= DATE '2001-01-01' AND day < DATE '2001-12-31'"), body=f"""
SELECT g.id, g.month, {sr('COALESCE(vh, 0) - COALESCE(vv, 0)', 'ratio', 12)}, {sr('COALESCE(vh, 0)', 'vh', 12)}, {sr('COALESCE(vv, 0)', 'vv', 12)} FROM (
  SELECT g.id, g.month, CASE WHEN p.month IS NULL THEN g.vh ELSE m.vh END AS vh, CASE WHEN p.month IS NULL THEN g.vv ELSE m.vv END AS vv
  FROM grid g LEFT JOIN monthly m ON m.id = g.id AND m.month = g.month LEFT JOIN (SELECT DISTINCT month FROM monthly) p ON p.month = g.month) g"""))
def monthly_collection(spark, sf):
    rows = radar_obs(spark, sf).where("day >= DATE '2001-01-01' AND day < DATE '2001-12-31'")
    return radar_long(monthly_radar(rows, "id", "day"))


@query("monthly_fallback_pixel", with_ctes(MONTHS.format(where=""), body=f"""
SELECT g.id, g.month, {sr('COALESCE(m.vh, g.vh) - COALESCE(m.vv, g.vv)', 'ratio', 12)},
       {sr('COALESCE(m.vh, g.vh)', 'vh', 12)}, {sr('COALESCE(m.vv, g.vv)', 'vv', 12)}
FROM grid g LEFT JOIN monthly m ON m.id = g.id AND m.month = g.month"""))
def monthly_pixel(spark, sf):
    return radar_long(monthly_radar(radar_obs(spark, sf), "id", "day", fallback="pixel"))


@query("climate_aggregate", f"""
SELECT l_suppkey AS id, {sr('avg(l_quantity)', 'temp_max')}, {sr('avg(l_quantity - l_linenumber)', 'temp_min')}, {sr('sum(l_tax)', 'precip_sum')}
FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-12-31' GROUP BY l_suppkey
""")
def climate(spark, sf):
    daily = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("id"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("temp_max"),
        (F.col("l_quantity") - F.col("l_linenumber")).alias("temp_min"), F.col("l_tax").alias("precip"),
    )
    out = climate_aggregate(daily, "id", "day", "1997-01-01", "1997-12-31")
    return rounded(out, ["temp_max", "temp_min", "precip_sum"])


MODAL = """s1 AS (SELECT o_custkey AS id, count(*) AS n_scenes, max(o_totalprice) AS peak FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
cov AS (SELECT c_custkey AS id, c_acctbal AS clay, c_nationkey AS peak FROM customer WHERE c_mktsegment <> 'MACHINERY')"""


def modalities(spark, sf):
    s1 = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n_scenes"), F.max("o_totalprice").alias("peak")
    )
    cov = table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("clay"), F.col("c_nationkey").alias("peak")
    )
    return s1, cov


@query("multimodal_align", with_ctes(MODAL, body="""
SELECT s1.id, n_scenes, s1.peak, clay FROM s1 JOIN cov ON s1.id = cov.id"""))
def multimodal_align(spark, sf):
    return align.inner_by_id(*modalities(spark, sf), "id")


@query("series_gather", with_ctes(OBS, COMP, MODAL, body="""
SELECT pixel_id AS id, year, bin, nir, clay FROM comp JOIN cov ON pixel_id = id"""))
def series_gather(spark, sf):
    _, cov = modalities(spark, sf)
    rows = composites(spark, sf).select(F.col("pixel_id").alias("id"), "year", "bin", "nir")
    return align.inner_by_id(rows, cov.select("id", "clay"), "id")


@query("missing_modality", with_ctes(MODAL, body="""
SELECT cov.id, clay, CAST(COALESCE(s1.n_scenes, 0) AS DOUBLE) AS n_scenes FROM cov LEFT JOIN s1 ON s1.id = cov.id"""))
def missing_modality(spark, sf):
    s1, cov = modalities(spark, sf)
    s1 = s1.select("id", F.col("n_scenes").cast("double").alias("n_scenes"))
    return align.left_by_id(cov.select("id", "clay"), s1, "id", fill=0.0)


@query("zero_modality", with_ctes(MODAL, body="""
SELECT id, clay, CAST(0 AS DOUBLE) AS vv_01, CAST(0 AS DOUBLE) AS ratio_12 FROM cov"""))
def zero_modality(spark, sf):
    _, cov = modalities(spark, sf)
    zeros = align.zero_modality(cov, "id", radar_columns())
    return align.inner_by_id(cov.select("id", "clay"), zeros, "id").select("id", "clay", "vv_01", "ratio_12")


@query("covariate_attach", with_ctes(OBS, COMP, PIXEL, body="""
SELECT c.pixel_id, c.year, c.bin, c.red, p.elevation FROM comp c LEFT JOIN (SELECT * FROM pixel WHERE y <> 3) p ON p.pixel_id = c.pixel_id"""))
def covariate_attach(spark, sf):
    statics = pixels(spark, sf).where("y <> 3").select("pixel_id", "elevation")
    return align.left_by_id(composites(spark, sf).select("pixel_id", "year", "bin", "red"), statics, "pixel_id")


@query("unmatched_audit", with_ctes(MODAL, body="""
SELECT count(*) AS n_raw, count(b.id) AS n_aligned, count(*) - count(b.id) AS n_unmatched
FROM (SELECT c_custkey AS id FROM customer) a LEFT JOIN (SELECT s1.id FROM s1 JOIN cov ON s1.id = cov.id) b ON a.id = b.id"""))
def unmatched(spark, sf):
    raw = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return align.unmatched_audit(raw, align.inner_by_id(*modalities(spark, sf), "id"), "id")


@query("positional_align", """
WITH a AS (SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS id, s_suppkey FROM supplier),
b AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS id, c_custkey FROM customer)
SELECT a.id, s_suppkey, c_custkey FROM a JOIN b ON a.id = b.id
""")
def positional(spark, sf):
    a = table(spark, sf, "supplier").select("s_suppkey", (-F.col("s_acctbal")).alias("k"))
    b = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    zipped = align.align_by_position([a, b], [["k", "s_suppkey"], ["c_acctbal", "c_custkey"]])
    return zipped.select("id", "s_suppkey", "c_custkey")


@query("zone_union", with_ctes(OBS, body="""
SELECT zone, y, count(*) AS n FROM (SELECT 0 AS zone, s_nationkey % 5 AS y FROM supplier UNION ALL SELECT 1, c_nationkey % 5 FROM customer)
GROUP BY zone, y"""))
def zone_union(spark, sf):
    first = table(spark, sf, "supplier").select(F.lit(0).alias("zone"), (F.col("s_nationkey") % 5).alias("y"))
    second = table(spark, sf, "customer").select(F.lit(1).alias("zone"), (F.col("c_nationkey") % 5).alias("y"))
    return first.unionByName(second).groupBy("zone", "y").agg(F.count(F.lit(1)).alias("n"))


@query("code_difference", """
SELECT DISTINCT p_size AS code FROM part WHERE p_size BETWEEN 1 AND 60 AND p_size NOT IN (1, 2, 3, 5)
""")
def code_difference(spark, sf):
    codes = table(spark, sf, "part").where("p_size BETWEEN 1 AND 60").select(F.col("p_size").alias("code")).distinct()
    main = spark.createDataFrame([(c,) for c in (1, 2, 3, 5)], "code int")
    return codes.join(main, "code", "left_anti")


TILE_ROWS = [("a", 0.0, 0.0, 50.0, 25.0, 20, 20), ("b", 900.0, 0.0, 40.0, 50.0, 10, 20), ("c", 0.0, 1500.0, 90.0, -45.0, 20, 20)]
TILES = f"""tiles(tile_id, x0, y0, dx, dy, n_rows, n_cols) AS (VALUES {', '.join(map(str, TILE_ROWS))}),
cells AS (
  SELECT CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS tile_id,
         (p_partkey // 3) // 20 AS row, (p_partkey // 3) % 20 AS col, p_retailprice AS elevation, p_size AS size FROM part),
pts AS (SELECT c_custkey AS id, CAST(c_custkey * 7 % 2200 AS DOUBLE) AS x, CAST(c_custkey * 13 % 1700 AS DOUBLE) AS y FROM customer)"""


def tile_geometry(spark):
    return spark.createDataFrame(TILE_ROWS, "tile_id string, x0 double, y0 double, dx double, dy double, n_rows int, n_cols int")


def tile_cells(spark, sf):
    key = F.expr("p_partkey div 3")
    tile = F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, sf, "part").select(
        tile.alias("tile_id"), row_of(key, 20).alias("row"), col_of(key, 20).alias("col"),
        F.col("p_retailprice").alias("elevation"), F.col("p_size").alias("size"),
    )


INSIDE = """floor((y - y0) / dy) >= 0 AND floor((y - y0) / dy) < n_rows AND floor((x - x0) / dx) >= 0 AND floor((x - x0) / dx) < n_cols"""
PLACE = """CAST(floor((y - y0) / dy) AS BIGINT) AS row, CAST(floor((x - x0) / dx) AS BIGINT) AS col"""


@query("tile_sample_join", f"""WITH {TILES},
placed AS (SELECT id, tile_id, {PLACE} FROM pts JOIN tiles ON {INSIDE})
SELECT id, tile_id, row, col, elevation, size FROM (SELECT id FROM pts) LEFT JOIN placed USING (id) LEFT JOIN cells USING (tile_id, row, col)""")
def tile_sample_join(spark, sf):
    """Points sampled from three tiles, two of which overlap."""
    key = F.col("c_custkey")
    points = table(spark, sf, "customer").select(
        key.alias("id"), (key * 7 % 2200).cast("double").alias("x"), (key * 13 % 1700).cast("double").alias("y")
    )
    out = align.sample_tiles(points, tile_cells(spark, sf), tile_geometry(spark), x="x", y="y")
    return out.select("id", "tile_id", "row", "col", "elevation", "size")


@query("covariate_chain", f"""WITH {TILES},
t AS (SELECT row AS r, col AS c, x0 + (col + 0.5) * dx AS x, y0 + (row + 0.5) * dy AS y FROM cells JOIN tiles USING (tile_id) WHERE tile_id = 'b'),
pa AS (SELECT r, c, {PLACE} FROM t JOIN tiles ON tile_id = 'a' AND {INSIDE}),
pc AS (SELECT r, c, {PLACE} FROM t JOIN tiles ON tile_id = 'c' AND {INSIDE}),
va AS (SELECT r, c, size AS soil FROM pa JOIN cells k ON k.tile_id = 'a' AND k.row = pa.row AND k.col = pa.col),
vc AS (SELECT r, c, elevation FROM pc JOIN cells k ON k.tile_id = 'c' AND k.row = pc.row AND k.col = pc.col)
SELECT r AS row, c AS col, soil, elevation FROM t LEFT JOIN va USING (r, c) LEFT JOIN vc USING (r, c)""")
def covariate_chain(spark, sf):
    """Target cells joined with two further grids at their centres, in one chain."""
    cells, tiles = tile_cells(spark, sf), tile_geometry(spark)
    soil = cells.where("tile_id = 'a'").select("tile_id", "row", "col", F.col("size").alias("soil"))
    terrain = cells.where("tile_id = 'c'").select("tile_id", "row", "col", "elevation")
    out = align.align_tiles(
        cells.where("tile_id = 'b'").select("tile_id", "row", "col"), tiles,
        [(soil, tiles.where("tile_id = 'a'")), (terrain, tiles.where("tile_id = 'c'"))],
    )
    return out.select("row", "col", "soil", "elevation")
