"""Scans, catalogs, chunk merging and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.functions.geo import col_of, parse_point, row_of, within
from phenoframe.functions.labels import clip_label
from phenoframe.functions.masks import nodata_to_null
from phenoframe.operators import filters
from phenoframe.operators.align import coerce_id, merge_chunks, unknown_ids
from phenoframe.operators.composite import series_to_long
from phenoframe.operators.labels import label_eligible
from phenoframe.registry.base import query, r, sr
from phenoframe.registry.roles import (
    BANDS, COMP, OBS, PIXEL, composites, observations, pixel_labels, pixels, table, with_ctes,
)
from phenoframe.scale.bounds import materialised
from phenoframe.schemas import CHUNK_STEPS, N_STEPS
from phenoframe.sources.chunks import fold_series, infer_columns, label_column
from phenoframe.sources.scenes import band_catalog, missing_bands, scene_lines
from phenoframe.sources.tables import identified_points, raster_values, static_columns


@query("scene_catalog", """
SELECT scene_path, CAST(o_orderdate AS DATE) AS acq_date FROM (
  SELECT o_orderdate, o_orderstatus,
         '/scenes/S2A_MSIL2A_' || strftime(o_orderdate, '%Y%m%d') || 'T162901_N0_' || o_orderkey || '.SAFE' AS scene_path
  FROM orders) WHERE o_orderstatus <> 'F'
""")
def scene_catalog(spark, sf):
    path = F.concat(
        F.lit("/scenes/S2A_MSIL2A_"), F.date_format("o_orderdate", "yyyyMMdd"),
        F.lit("T162901_N0_"), F.col("o_orderkey").cast("string"), F.lit(".SAFE"),
    )
    commented = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("  # "), path)).otherwise(
        F.concat(F.lit("  "), path, F.lit(" "))
    )
    return scene_lines(table(spark, sf, "orders").select(commented.alias("value")))


FILES = """files AS (
  SELECT 'S' || l_suppkey AS scene, 'L2A_' || l_linestatus AS granule,
         CASE l_returnflag WHEN 'A' THEN 'R10m' WHEN 'R' THEN 'R20m' ELSE 'R60m' END AS resolution,
         printf('B%02d', l_linenumber) AS band, l_partkey
  FROM lineitem),
paths AS (
  SELECT *, '/data/' || scene || '/GRANULE/' || granule || '/IMG_DATA/' || resolution || '/T_' || band || '_' || l_partkey || '.jp2' AS file_path
  FROM files),
ranked AS (
  SELECT *, CASE resolution WHEN 'R10m' THEN 1 ELSE 2 END AS rank,
         min(granule) OVER (PARTITION BY scene) AS first_granule
  FROM paths WHERE resolution <> 'R60m'),
catalog AS (
  SELECT scene, band, resolution, file_path FROM (
    SELECT *, row_number() OVER (PARTITION BY scene, band ORDER BY rank, file_path) AS place
    FROM ranked WHERE granule = first_granule) WHERE place = 1)"""


def band_files(spark, sf):
    flag = F.col("l_returnflag")
    folder = F.when(flag == "A", "R10m").when(flag == "R", "R20m").otherwise("R60m")
    return table(spark, sf, "lineitem").select(
        F.concat(
            F.lit("/data/S"), F.col("l_suppkey").cast("string"), F.lit("/GRANULE/L2A_"), "l_linestatus",
            F.lit("/IMG_DATA/"), folder, F.lit("/T_"), F.format_string("B%02d", "l_linenumber"),
            F.lit("_"), F.col("l_partkey").cast("string"), F.lit(".jp2"),
        ).alias("file_path")
    )


@query("band_catalog", with_ctes(FILES, body="SELECT * FROM catalog"))
def bands_of_scenes(spark, sf):
    return band_catalog(band_files(spark, sf))


@query("missing_bands", with_ctes(FILES, body="""
SELECT scene, band FROM (SELECT DISTINCT scene FROM catalog) s,
       (SELECT unnest(['B01', 'B02', 'B08', 'B11']) AS band) b
WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.scene = s.scene AND c.band = b.band)
"""))
def absent_bands(spark, sf):
    return missing_bands(band_catalog(band_files(spark, sf)), ["B01", "B02", "B08", "B11"])


@query("point_fallback", """
SELECT id, min_by(lon, (lon, lat)) AS lon, min_by(lat, (lon, lat)) AS lat FROM (
  SELECT o_custkey AS id, NULLIF(o_totalprice, 0) AS lon, CAST(o_orderkey AS DOUBLE) AS lat FROM orders)
GROUP BY id
""")
def point_fallback(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("system:index"),
        F.nullif("o_totalprice", F.lit(0.0)).alias("lon"),
        F.col("o_orderkey").cast("double").alias("lat"),
    )
    return identified_points(rows)


NAMES = {"green": "B3", "red": "B4", "nir": "B8", "swir": "B11"}


def wide_chunks(spark, sf):
    """Composites as four wide chunks whose keys and properties differ."""
    label = pixel_labels(spark, sf).withColumnRenamed("y", "crop_label")
    rows = materialised(composites(spark, sf).join(label, "pixel_id"))
    index = F.concat_ws("_", F.col("pixel_id").cast("string"), F.col("year").cast("string"))
    chunks = []
    for k, (first, last) in enumerate(CHUNK_STEPS):
        part = rows.where(F.col("bin").between(first, last))
        cells = []
        for t in range(first, last + 1):
            cells += [F.expr(f"max(IF(bin = {t}, {b}, NULL)) AS {NAMES[b]}_t{t}") for b in BANDS]
            cells.append(F.expr(f"max(IF(bin = {t}, CAST(valid AS INT), NULL)) AS m_t{t}"))
        chunk = part.groupBy(index.alias("system:index"), "crop_label").agg(*cells)
        chunks.append(chunk.withColumn("lon", F.lit(1.5)) if k == 0 else chunk)
    return chunks


WIDE = """keys AS (SELECT DISTINCT c.pixel_id, year, y FROM comp c JOIN pixel p ON p.pixel_id = c.pixel_id),
grid AS (SELECT *, CAST(unnest(range(36)) AS INT) AS t FROM keys)"""


@query("chunk_merge", with_ctes(OBS, COMP, PIXEL, WIDE, body=f"""
SELECT g.pixel_id || '_' || g.year AS sample, g.y AS crop_label, g.t,
       {sr('CAST(green AS FLOAT)', 'green', 4)}, {sr('CAST(red AS FLOAT)', 'red', 4)}, {sr('CAST(nir AS FLOAT)', 'nir', 4)}, {sr('CAST(swir AS FLOAT)', 'swir', 4)},
       COALESCE(valid, false) AS valid
FROM grid g LEFT JOIN comp c ON c.pixel_id = g.pixel_id AND c.year = g.year AND c.bin = g.t
"""))
def chunk_merge(spark, sf):
    merged = merge_chunks(wide_chunks(spark, sf), "system:index", ["crop_label", "lon"], "crop_label")
    features, masks = infer_columns(merged.columns)
    assert (len(features), len(masks)) == (4 * N_STEPS, N_STEPS)
    y = label_column(merged.columns)
    folded = fold_series(merged, [NAMES[b] for b in BANDS])
    long = series_to_long(folded.withColumnRenamed("system:index", "sample"), ["sample", y], BANDS)
    return long.select("sample", y, "t", *[r(b, 4).alias(b) for b in BANDS], "valid")


# Line items as two chunks of a wide table, whose keys, the suppliers, are in each many times.
@query("chunk_first_rows", """
WITH a AS (SELECT * FROM lineitem WHERE l_linenumber <= 3 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) = 1),
b AS (SELECT * FROM lineitem WHERE l_linenumber > 3 AND l_suppkey % 3 > 0 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber) = 1)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS sample, CASE WHEN a.l_suppkey IS NULL THEN b.l_partkey ELSE a.l_partkey END AS crop_label,
  NULLIF(a.l_quantity, 25) AS B2_t0, a.l_tax AS B2_t1, coalesce(CAST(a.l_discount > 0.05 AS INT), 0) AS m_t0,
  b.l_extendedprice AS B8A_t2, coalesce(CAST(b.l_discount > 0.05 AS INT), 0) AS m_t2
FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey
""")
def chunk_first_rows(spark, sf):
    """Of the rows of a key in a chunk the first is taken whole."""
    lines = table(spark, sf, "lineitem")
    order, line, flag = F.col("l_orderkey"), F.col("l_linenumber"), (F.col("l_discount") > 0.05).cast("int")
    key, label = F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("crop_label")
    a = lines.where("l_linenumber <= 3").select(
        key, label, F.nullif("l_quantity", F.lit(25.0)).alias("B2_t0"), F.col("l_tax").alias("B2_t1"), flag.alias("m_t0"),
        F.lit("x").alias("note_too"), F.struct(order, line).alias("_order"),
    )
    b = lines.where("l_linenumber > 3 AND l_suppkey % 3 > 0").select(
        key, label, F.col("l_extendedprice").alias("B8A_t2"), flag.alias("m_t2"), F.struct(-order, line).alias("_order")
    )
    return merge_chunks([a, b], "sample", ["crop_label"])


@query("scene_class_filter", with_ctes(OBS, body="""
SELECT scl, count(*) AS n, min(obs_date) AS first_date, max(obs_date) AS last_date
FROM obs WHERE scl NOT IN (1, 3, 8, 9, 10, 11) GROUP BY scl"""))
def scene_class_filter(spark, sf):
    return filters.clear_scenes(observations(spark, sf)).groupBy("scl").agg(
        F.count(F.lit(1)).alias("n"), F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date")
    )


AREAS = [(0.0, -500.0, 4000.0, 5.0), (3000.0, 3.0, 9000.0, 20.0)]


@query("bbox_filter", """
SELECT c_custkey AS id, c_acctbal AS lon, CAST(c_nationkey AS DOUBLE) AS lat FROM customer
WHERE (c_acctbal BETWEEN 0 AND 4000 AND c_nationkey BETWEEN -500 AND 5)
   OR (c_acctbal BETWEEN 3000 AND 9000 AND c_nationkey BETWEEN 3 AND 20)
""")
def bbox_filter(spark, sf):
    rows = table(spark, sf, "customer").where(within(F.col("c_acctbal"), F.col("c_nationkey"), AREAS))
    return rows.select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("lon"), F.col("c_nationkey").cast("double").alias("lat")
    )


@query("date_range_filter", """
SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS total FROM lineitem
WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-12-31' GROUP BY l_returnflag
""")
def date_range_filter(spark, sf):
    rows = filters.in_dates(table(spark, sf, "lineitem"), "l_shipdate", "1997-01-01", "1997-12-31")
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))


@query("acquisition_filter", """
SELECT o_orderkey AS scene_id, o_orderstatus AS orbit FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= DATE '1996-01-01' AND o_orderstatus = 'O'
""")
def acquisition_filter(spark, sf):
    scenes = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("scene_id"),
        F.col("o_orderstatus").alias("orbit"),
        F.when(F.col("o_orderdate") >= F.lit("1996-01-01").cast("date"), "IW").otherwise("EW").alias("mode"),
        F.when(F.substring("o_orderpriority", 1, 1) <= "2", F.array(F.lit("VV"), F.lit("VH")))
        .otherwise(F.array(F.lit("VV"))).alias("polarisations"),
    )
    return filters.acquisitions(scenes, orbit="O").select("scene_id", "orbit")


@query("eligible_pixels", """
SELECT p_partkey AS pixel_id,
       CASE WHEN p_size <> 0 AND p_retailprice / 15 >= 95 AND CAST(round_even(p_size * 0.5 + 30, 0) AS INT) = 40
            THEN p_size END AS label
FROM part
""")
def eligible_pixels(spark, sf):
    grid = table(spark, sf, "part").select(
        F.col("p_partkey").alias("pixel_id"), F.col("p_size").alias("label"), F.col("p_size").alias("code"),
        (F.col("p_retailprice") / 15).alias("conf"), (F.col("p_size") * 0.5 + 30).alias("cover"),
    )
    return label_eligible(grid, "label", "code", "conf", "cover").select("pixel_id", "label")


@query("confidence_mask", """
SELECT p_partkey AS pixel_id, p_size AS code FROM part WHERE p_size + 50 > 85
""")
def confidence_mask(spark, sf):
    grid = table(spark, sf, "part").select(
        F.col("p_partkey").alias("pixel_id"), F.col("p_size").alias("code"), (F.col("p_size") + 50).alias("conf")
    )
    return filters.confident(grid, "conf").select("pixel_id", "code")


@query("coerce_ids", """
SELECT TRY_CAST(TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN 'x' || o_orderkey WHEN o_orderstatus = 'O'
       THEN o_orderkey || '.0' ELSE CAST(o_orderkey AS VARCHAR) END AS DOUBLE) AS BIGINT) AS id, o_custkey
FROM orders WHERE o_orderstatus <> 'F'
""")
def coerce_ids(spark, sf):
    key = F.col("o_orderkey").cast("string")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("x"), key))
        .when(F.col("o_orderstatus") == "O", F.concat(key, F.lit(".0")))
        .otherwise(key)
    )
    return coerce_id(table(spark, sf, "orders").select(text.alias("id"), "o_custkey"), "id")


@query("id_range_check", """
SELECT DISTINCT l_partkey + 1 AS id FROM lineitem
WHERE l_partkey + 1 NOT IN (SELECT p_partkey FROM part WHERE p_size < 45) ORDER BY id LIMIT 8
""")
def id_range_check(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") + 1).alias("id"))
    known = table(spark, sf, "part").where("p_size < 45").select(F.col("p_partkey").alias("id"))
    return unknown_ids(rows, known, "id")


@query("nodata_to_null", """
SELECT l_linenumber, count(NULLIF(l_discount, 0)) AS n_discount, count(NULLIF(l_tax, 0)) AS n_tax, count(*) AS n
FROM lineitem GROUP BY l_linenumber
""")
def nodata(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        F.count(nodata_to_null(F.col("l_discount"), 0.0)).alias("n_discount"),
        F.count(nodata_to_null(F.col("l_tax"), 0.0)).alias("n_tax"),
        F.count(F.lit(1)).alias("n"),
    )


@query("label_clip", """
SELECT s_suppkey AS pixel_id, least(greatest(s_nationkey - 3, 0), 5) AS y FROM supplier
""")
def label_clip(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("pixel_id"), clip_label(F.col("s_nationkey") - 3, 6).alias("y")
    )


@query("geojson_points", """
SELECT c_custkey AS id, c_acctbal AS lon, c_nationkey / 2 AS lat FROM customer
""")
def geojson_points(spark, sf):
    text = F.concat(
        F.lit('{"geodesic":false,"type":"Point","coordinates":['), F.col("c_acctbal").cast("string"),
        F.lit(","), (F.col("c_nationkey") / 2).cast("string"), F.lit("]}"),
    )
    parsed = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), parse_point(text).alias("p"))
    return parsed.select("id", "p.lon", "p.lat")


@query("static_columns", """
SELECT c_nationkey AS id, round(sum(c_acctbal), 2) AS balance, count(c_mktsegment) AS segments FROM customer GROUP BY c_nationkey
""")
def covariate_projection(spark, sf):
    stats = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(
        F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count("c_mktsegment").alias("segments"),
        F.max("c_acctbal").alias("lon"), F.min("c_acctbal").alias("lat"),
    )
    return stats.select("id", *static_columns(stats.columns))


@query("drop_unlabelled", """
SELECT p_partkey AS pixel_id, CASE WHEN p_size > 10 THEN p_size END AS crop_label FROM part WHERE p_size > 10
""")
def drop_unlabelled(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("pixel_id"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("crop_label"),
        F.col("p_name").alias(".geo"),
    )
    return filters.labelled(rows, "crop_label")


@query("raster_scan", """
SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, NULLIF(p_size, 1) AS b2, NULLIF(p_retailprice, 900) AS b3 FROM part
""")
def raster_scan(spark, sf):
    idx = F.col("p_partkey")
    stored = table(spark, sf, "part").select(
        row_of(idx, 50).alias("row"), col_of(idx, 50).alias("col"), F.col("p_size").alias("b2"), F.col("p_retailprice").alias("b3")
    )
    return raster_values(raster_values(stored, ["b2"], 1), ["b3"], 900.0)


@query("year_fallback", """
SELECT o_orderpriority, CAST(month(o_orderdate) AS INT) AS month, count(*) AS n FROM orders
WHERE year(o_orderdate) = 2001 AND o_orderstatus = 'O' GROUP BY ALL
""")
def year_fallback(spark, sf):
    ascending = table(spark, sf, "orders").where("o_orderstatus = 'O'")
    rows = filters.year_or_previous(ascending, "o_orderdate", 2002)
    return rows.groupBy("o_orderpriority", F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
