"""Row-local functions: reflectance, indices, masks, resampling, gap filling, terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.functions.arrays import append_mask_channel, permute_axes, radar_tensor, repeat_static
from phenoframe.functions.gaps import fill_series
from phenoframe.functions.geo import cell, centre, col_of, row_of
from phenoframe.functions import masks
from phenoframe.functions.spectral import append_indices, ndvi, ndwi, radar_ratio, reflectance, silt
from phenoframe.functions.temporal import (
    bin_bounds, decadal_bin, resample_linear, resample_mask_nearest, step_day,
)
from phenoframe.operators.composite import radar_columns, series_to_long
from phenoframe.operators.filters import enough_steps
from phenoframe.operators.gapfill import fill_gaps, irregular_to_grid
from phenoframe.operators.terrain import slope_aspect
from phenoframe.registry.base import query, r, rounded, sr
from phenoframe.registry.roles import (
    BANDS, COMP, DENSE, OBS, TENSOR, TENSOR_CHANNELS, TENSOR_STEPS, dense, observations, samples,
    table, tensor_rows, tensors, with_ctes,
)

REFL = "CASE WHEN {0} > 1.5 THEN {0} / 10000 WHEN {0} IS NOT NULL THEN least(greatest({0}, 0), 1) END"


@query("reflectance", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {sr('avg(' + REFL.format('l_quantity * 0.05') + ')', 'refl', 9)},
       count(*) AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey
""")
def reflectance_of(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        r(F.avg(reflectance(F.col("l_quantity") * 0.05)), 9).alias("refl"), F.count(F.lit(1)).alias("n")
    )


NR, RR = REFL.format("nir"), REFL.format("red")


@query("ndvi_variants", with_ctes(OBS, body=f"""
SELECT pixel_id, obs_date,
       {sr('avg((nir - red) / (nir + red + 1e-6))', 'epsilon')},
       {sr('avg(CASE WHEN nir + red = 0 THEN 0 ELSE (nir - red) / (nir + red) END)', 'zero')},
       {sr(f'avg(CASE WHEN {NR} + {RR} > 1e-6 THEN least(greatest(({NR} - {RR}) / ({NR} + {RR}), -1), 1) ELSE 0 END)', 'clipped')}
FROM obs GROUP BY pixel_id, obs_date"""))
def ndvi_variants(spark, sf):
    rows = observations(spark, sf)
    return rows.groupBy("pixel_id", "obs_date").agg(
        *[r(F.avg(ndvi(F.col("nir"), F.col("red"), v))).alias(v) for v in ("epsilon", "zero", "clipped")]
    )


@query("ndwi", with_ctes(OBS, body=f"""
SELECT pixel_id, {sr('avg((green - nir) / (green + nir + 1e-6))', 'ndwi')}, count(green) AS n
FROM obs GROUP BY pixel_id"""))
def water_index(spark, sf):
    return observations(spark, sf).groupBy("pixel_id").agg(
        r(F.avg(ndwi(F.col("green"), F.col("nir")))).alias("ndwi"), F.count("green").alias("n")
    )


GR = REFL.format("green")


@query("append_indices", with_ctes(OBS, COMP, DENSE, body=f"""
SELECT pixel_id, year, t, {sr(REFL.format('swir'), 'swir')},
       {sr(f'({NR} - {RR}) / ({NR} + {RR} + 1e-6)', 'ndvi')},
       {sr(f'({GR} - {NR}) / ({GR} + {NR} + 1e-6)', 'ndwi')}
FROM dense"""))
def indices_appended(spark, sf):
    wide = append_indices(F.col("series"), BANDS, "green", "red", "nir")
    rows = samples(spark, sf).withColumn("series", wide)
    long = series_to_long(rows, ["pixel_id", "year"], [*BANDS, "ndvi", "ndwi"])
    return rounded(long.select("pixel_id", "year", "t", "swir", "ndvi", "ndwi"), ["swir", "ndvi", "ndwi"])


@query("silt", f"""
SELECT p_partkey AS id, {sr('100 - p_size - p_retailprice / 50', 'silt')} FROM part
""")
def silt_share(spark, sf):
    rows = table(spark, sf, "part")
    return rows.select(F.col("p_partkey").alias("id"), r(silt(F.col("p_size"), F.col("p_retailprice") / 50)).alias("silt"))


@query("radar_ratio", f"""
SELECT o_orderkey AS id, {sr('-o_totalprice / 20000 - (-o_custkey / 1000)', 'ratio', 8)} FROM orders
""")
def ratio(spark, sf):
    rows = table(spark, sf, "orders")
    vh, vv = -F.col("o_totalprice") / 20000, -F.col("o_custkey") / 1000
    return rows.select(F.col("o_orderkey").alias("id"), r(radar_ratio(vh, vv), 8).alias("ratio"))


@query("decadal_bins", with_ctes(OBS, body="""
SELECT b.bin, b.start_doy, b.end_doy, count(o.pixel_id) AS n_clamp,
       count(CASE WHEN dayofyear(o.obs_date) <= 360 THEN 1 END) AS n_drop
FROM (SELECT CAST(i AS INT) AS bin, CAST(i * 10 + 1 AS INT) AS start_doy, CAST(i * 10 + 11 AS INT) AS end_doy FROM range(36) x(i)) b
LEFT JOIN obs o ON least((dayofyear(o.obs_date) - 1) // 10, 35) = b.bin
GROUP BY b.bin, b.start_doy, b.end_doy"""))
def bins(spark, sf):
    day = F.col("obs_date")
    counts = observations(spark, sf).groupBy(decadal_bin(day).alias("bin")).agg(
        F.count(F.lit(1)).alias("n_clamp"), F.count(decadal_bin(day, tail="drop")).alias("n_drop")
    )
    return bin_bounds(spark).join(counts, "bin", "left").fillna(0, ["n_clamp", "n_drop"])


@query("cell_index", f"""
SELECT p_partkey AS idx, p_partkey // 50 AS row, p_partkey % 50 AS col,
       {sr('100 + (p_partkey % 50 + 0.5) * 30', 'x')}, {sr('5000 + (p_partkey // 50 + 0.5) * -30', 'y')},
       CAST(floor((p_retailprice - 100) / 30) AS BIGINT) AS price_cell
FROM part
""")
def cell_index(spark, sf):
    idx = F.col("p_partkey")
    row, col = row_of(idx, 50), col_of(idx, 50)
    return table(spark, sf, "part").select(
        idx.alias("idx"), row.alias("row"), col.alias("col"),
        r(centre(col, 100, 30)).alias("x"), r(centre(row, 5000, -30)).alias("y"),
        cell(F.col("p_retailprice"), 100, 30).alias("price_cell"),
    )


@query("radar_tensor", f"""
SELECT o_custkey AS id, m AS month,
       {sr("avg(CASE WHEN month(o_orderdate) = m THEN -o_totalprice / 20000 END) - avg(CASE WHEN month(o_orderdate) = m THEN -o_totalprice / 30000 END)", 'ratio', 10)},
       {sr("avg(CASE WHEN month(o_orderdate) = m THEN -o_totalprice / 20000 END)", 'vh', 10)},
       {sr("avg(CASE WHEN month(o_orderdate) = m THEN -o_totalprice / 30000 END)", 'vv', 10)}
FROM orders, (SELECT CAST(i AS INT) AS m FROM range(1, 13) x(i)) GROUP BY o_custkey, m
""")
def radar_months(spark, sf):
    orders = table(spark, sf, "orders")
    price, month = F.col("o_totalprice"), F.month("o_orderdate")
    wide = orders.groupBy(F.col("o_custkey").alias("id")).agg(
        *[F.avg(F.when(month == m, -price / 20000)).alias(f"vh_{m:02d}") for m in range(1, 13)],
        *[F.avg(F.when(month == m, -price / 30000)).alias(f"vv_{m:02d}") for m in range(1, 13)],
    )
    wide = wide.withColumns({f"ratio_{m:02d}": F.col(f"vh_{m:02d}") - F.col(f"vv_{m:02d}") for m in range(1, 13)})
    names = radar_columns()
    tensor = radar_tensor(*[[F.col(c) for c in names[i::3]] for i in range(3)])
    long = wide.select("id", F.posexplode_outer(tensor).alias("m", "s"))
    return long.select(
        "id", (F.col("m") + 1).alias("month"), *[r(f"s.{c}", 10).alias(c) for c in ("ratio", "vh", "vv")]
    )


@query("nonfinite_to_zero", f"""
SELECT vec_id, t, c, {sr('CASE WHEN x IS NULL OR x > 0.3 OR x < -0.3 THEN 0 ELSE x END', 'x')}
FROM (SELECT vec_id, CAST(i // 4 AS INT) AS t, CAST(i % 4 AS INT) AS c, CAST(embedding[i + 1] AS DOUBLE) AS x
      FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))
WHERE NOT isnan(x)
""")
def nonfinite_to_zero(spark, sf):
    def spoilt(x):
        return F.when(x > 0.3, F.lit(float("inf"))).when(x < -0.3, F.lit(float("nan"))).otherwise(x)

    full = F.array(*[F.array(*[F.get("embedding", F.lit(4 * t + c)).cast("double") for c in range(4)]) for t in range(16)])
    rows = table(spark, sf, "embeddings").select("vec_id", full.alias("series"))
    broken = F.transform("series", lambda s: F.transform(s, spoilt))
    clean = rows.withColumn("series", masks.sanitise_series(broken))
    return rounded(tensor_rows(clean, ["vec_id"]), ["x"])


@query("mask_binarise", """
SELECT o_custkey AS id, count(*) AS n, count(CASE WHEN COALESCE(m, 0) > 0.5 THEN 1 END) AS n_valid
FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 END AS m FROM orders)
GROUP BY o_custkey
""")
def mask_binarise(spark, sf):
    status = F.col("o_orderstatus")
    m = F.when(status == "F", F.lit(1.0)).when(status == "O", F.lit(0.5))
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(masks.binarise(m)).alias("n_valid")
    )


RULES = ["any_finite", "any_above_eps", "any_nonzero", "finite_not_missing"]


@query("valid_step_mask", with_ctes(TENSOR, body="""
SELECT vec_id, t, count(x) > 0 AS any_finite, count(CASE WHEN abs(x) > 0.2 THEN 1 END) > 0 AS any_above_eps,
       count(CASE WHEN x <> 0 THEN 1 END) > 0 AS any_nonzero, count(CASE WHEN x <> 0 THEN 1 END) > 0 AS finite_not_missing
FROM tensor GROUP BY vec_id, t"""))
def valid_step_mask(spark, sf):
    rows = tensors(spark, sf)
    flags = [masks.valid_steps(F.col("series"), rule, 0.2).alias(rule) for rule in RULES]
    return rows.select("vec_id", F.posexplode_outer(F.arrays_zip(*flags)).alias("t", "m")).select("vec_id", "t", "m.*")


@query("mask_fallback", with_ctes(TENSOR, body="""
, given AS (SELECT vec_id, t, count(CASE WHEN x > 0.3 THEN 1 END) > 0 AS m, count(x) = 4 AS d FROM tensor GROUP BY vec_id, t)
SELECT vec_id, t, CASE WHEN bool_or(m) OVER w THEN m ELSE d END AS safe,
       CASE WHEN bool_or(m) OVER w THEN m ELSE t = 0 END AS ensured
FROM given WINDOW w AS (PARTITION BY vec_id)"""))
def mask_fallback(spark, sf):
    rows = tensors(spark, sf)
    given = F.transform("series", lambda s: F.exists(s, lambda x: F.coalesce(x > 0.3, F.lit(False))))
    derived = F.transform("series", lambda s: F.forall(s, lambda x: x.isNotNull()))
    rows = rows.select("vec_id", given.alias("m"), derived.alias("d"))
    both = F.arrays_zip(
        masks.mask_or_derived(F.col("m"), F.col("d")).alias("safe"), masks.ensure_one_valid(F.col("m")).alias("ensured")
    )
    return rows.select("vec_id", F.posexplode_outer(both).alias("t", "b")).select("vec_id", "t", "b.*")


@query("min_valid_filter", with_ctes(OBS, COMP, body="""
SELECT pixel_id, year, CAST(count(CASE WHEN valid THEN 1 END) AS INT) AS n_valid FROM comp
GROUP BY pixel_id, year HAVING count(CASE WHEN valid THEN 1 END) >= 29"""))
def min_valid_filter(spark, sf):
    kept = enough_steps(samples(spark, sf), at_least=29)
    return kept.select("pixel_id", "year", masks.count_valid(F.col("mask")).alias("n_valid"))


@query("append_mask_channel", with_ctes(TENSOR, body=f"""
SELECT vec_id, t, c, {sr('x', 'x')} FROM tensor
UNION ALL
SELECT vec_id, t, 4 AS c, {sr('CASE WHEN count(x) = 4 THEN 1 ELSE 0 END', 'x')} FROM tensor GROUP BY vec_id, t"""))
def mask_channel(spark, sf):
    full = F.transform("series", lambda s: F.forall(s, lambda x: x.isNotNull()))
    rows = tensors(spark, sf).withColumn("series", append_mask_channel(F.col("series"), full))
    return rounded(tensor_rows(rows, ["vec_id"]), ["x"])


@query("static_broadcast", with_ctes(TENSOR, body=f"""
SELECT vec_id, t, c, {sr('x', 'x')} FROM tensor
UNION ALL SELECT DISTINCT vec_id, t, 4 AS c, {sr('label', 'x')} FROM tensor
UNION ALL SELECT DISTINCT vec_id, t, 5 AS c, {sr('vec_id / 7', 'x')} FROM tensor"""))
def static_broadcast(spark, sf):
    rows = tensors(spark, sf)
    wide = repeat_static(F.col("series"), [F.col("label"), F.col("vec_id") / 7])
    return rounded(tensor_rows(rows.withColumn("series", wide), ["vec_id"]), ["x"])


@query("axis_permute", with_ctes(TENSOR, body=f"""
SELECT vec_id, c AS channel, t AS step, {sr('x', 'x')} FROM tensor"""))
def axis_permute(spark, sf):
    rows = tensors(spark, sf).withColumn("series", permute_axes(F.col("series"), TENSOR_CHANNELS))
    long = tensor_rows(rows, ["vec_id"])
    return long.select("vec_id", F.col("t").alias("channel"), F.col("c").alias("step"), r("x").alias("x"))


@query("resample_linear", with_ctes(TENSOR, body=f"""
, full_t AS (SELECT vec_id, t, c, COALESCE(x, 0) AS x FROM tensor),
grid AS (SELECT CAST(k AS INT) AS k, CAST(least(floor(k * 15 / 23), 14) AS INT) AS i, k * 15 / 23 - least(floor(k * 15 / 23), 14) AS a FROM range(24) g(k))
SELECT l.vec_id, k AS t, l.c, {sr('(1 - a) * l.x + a * h.x', 'x')}
FROM grid JOIN full_t l ON l.t = i JOIN full_t h ON h.vec_id = l.vec_id AND h.c = l.c AND h.t = i + 1"""))
def linear(spark, sf):
    filled = F.transform("series", lambda s: F.transform(s, lambda x: F.coalesce(x, F.lit(0.0))))
    rows = tensors(spark, sf).withColumn("series", filled)
    grid = resample_linear(F.col("series"), TENSOR_STEPS, 24)
    return rounded(tensor_rows(rows.withColumn("series", grid), ["vec_id"]), ["x"])


@query("mask_resample_nearest", with_ctes(TENSOR, body="""
, m AS (SELECT vec_id, t, count(x) = 4 AS valid FROM tensor GROUP BY vec_id, t),
grid AS (SELECT CAST(k AS INT) AS k, (SELECT min_by(j, (abs(j / 15 - k / 7), j)) FROM range(16) s(j)) AS j FROM range(8) g(k))
SELECT vec_id, k AS t, valid FROM grid JOIN m ON m.t = grid.j"""))
def nearest(spark, sf):
    full = F.transform("series", lambda s: F.forall(s, lambda x: x.isNotNull()))
    rows = tensors(spark, sf).select("vec_id", full.alias("m"))
    return rows.select(
        "vec_id", F.posexplode_outer(resample_mask_nearest(F.col("m"), TENSOR_STEPS, 8)).alias("t", "valid")
    )


@query("step_axis", with_ctes(OBS, COMP, body=f"""
SELECT bin AS t, count(*) AS n, CAST((bin + 1) * 10 AS INT) AS step_day, {sr('10.0 + bin * 350.0 / 35', 'even_day')}
FROM comp GROUP BY bin"""))
def step_axis(spark, sf):
    from phenoframe.registry.roles import composites

    counts = composites(spark, sf).groupBy(F.col("bin").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "t", "n", step_day(F.col("t")).alias("step_day"), r(step_day(F.col("t"), 36, "even")).alias("even_day")
    )


# Gap filling: previous and next value per step, then the line between them.
def _gap_sql(edge: str) -> str:
    before = {"hold": "nv", "fill": "-1", "leading_zero": "0"}[edge]
    after = {"hold": "pv", "fill": "-1", "leading_zero": "pv"}[edge]

    def value(b: str) -> str:
        return f"""CASE WHEN {b}_p IS NULL AND {b}_n IS NULL THEN 0
          WHEN {b}_p IS NULL THEN {before.replace('nv', b + '_nv')}
          WHEN {b}_n IS NULL THEN {after.replace('pv', b + '_pv')}
          WHEN {b}_p = {b}_n THEN {b}_pv
          ELSE {b}_pv + (t - {b}_p) / ({b}_n - {b}_p) * ({b}_nv - {b}_pv) END"""

    def ends(b: str) -> str:
        k = f"CASE WHEN {b} IS NOT NULL THEN t END"
        return f"""last_value({k} IGNORE NULLS) OVER p AS {b}_p, last_value({b} IGNORE NULLS) OVER p AS {b}_pv,
          first_value({k} IGNORE NULLS) OVER n AS {b}_n, first_value({b} IGNORE NULLS) OVER n AS {b}_nv"""

    return with_ctes(OBS, COMP, DENSE, body=f"""
    , ends AS (SELECT pixel_id, year, t, {', '.join(map(ends, BANDS))} FROM dense
      WINDOW p AS (PARTITION BY pixel_id, year ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             n AS (PARTITION BY pixel_id, year ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT pixel_id, year, t, {', '.join(sr(value(b), b, 8) for b in BANDS)} FROM ends""")


def _register_gapfill(edge: str, in_row: bool):
    name = f"gapfill_{edge}" + ("_in_row" if in_row else "")

    @query(name, _gap_sql(edge))
    def filled(spark, sf):
        keys = ["pixel_id", "year"]
        if in_row:
            series = fill_series(F.col("series"), len(BANDS), edge, -1.0)
            long = series_to_long(samples(spark, sf).withColumn("series", series), keys, BANDS)
        else:
            long = fill_gaps(dense(spark, sf), keys, "t", BANDS, edge=edge, fill=-1.0)
        return rounded(long.select(*keys, "t", *BANDS), BANDS, 8)


for _edge in ("hold", "fill", "leading_zero"):
    _register_gapfill(_edge, False)
    _register_gapfill(_edge, True)


@query("gapfill_masked", with_ctes(TENSOR, body=f"""
, m AS (SELECT vec_id, t, c, COALESCE(x, 0) AS x, count(x) OVER (PARTITION BY vec_id, t) >= 3 AS valid FROM tensor),
e AS (SELECT *, last_value(CASE WHEN valid THEN t END IGNORE NULLS) OVER p AS pt, last_value(CASE WHEN valid THEN x END IGNORE NULLS) OVER p AS pv,
        first_value(CASE WHEN valid THEN t END IGNORE NULLS) OVER n AS nt, first_value(CASE WHEN valid THEN x END IGNORE NULLS) OVER n AS nv FROM m
      WINDOW p AS (PARTITION BY vec_id, c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             n AS (PARTITION BY vec_id, c ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT vec_id, t, c, {sr('CASE WHEN pt IS NULL AND nt IS NULL THEN x WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN pt = nt THEN pv ELSE pv + (t - pt) / (nt - pt) * (nv - pv) END', 'x')}
FROM e"""))
def gapfill_masked(spark, sf):
    rows = tensors(spark, sf)
    valid = F.transform("series", lambda s: F.size(F.filter(s, lambda x: x.isNotNull())) >= 3)
    known = F.transform("series", lambda s: F.transform(s, lambda x: F.coalesce(x, F.lit(0.0))))
    rows = rows.select("vec_id", known.alias("series"), valid.alias("mask"))
    filled = fill_series(F.col("series"), TENSOR_CHANNELS, mask=F.col("mask"))
    return rounded(tensor_rows(rows.withColumn("series", filled), ["vec_id"]), ["x"])


GRID_SQL = f"""WITH o AS (SELECT user_id, event_type, epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS s, value AS v FROM events),
k AS (SELECT DISTINCT user_id, event_type FROM o),
g AS (SELECT user_id, event_type, CAST(i AS INT) AS t, 86400.0 * (i + 1) AS gt FROM k, range(28) x(i)),
b AS (SELECT g.user_id, g.event_type, g.t, any_value(g.gt) AS gt,
        max(CASE WHEN o.s <= g.gt THEN o.s END) AS ps, arg_max(o.v, o.s) FILTER (WHERE o.s <= g.gt) AS pv,
        min(CASE WHEN o.s >= g.gt THEN o.s END) AS ns, arg_min(o.v, o.s) FILTER (WHERE o.s >= g.gt) AS nv
      FROM g JOIN o ON o.user_id = g.user_id AND o.event_type = g.event_type GROUP BY g.user_id, g.event_type, g.t)
SELECT user_id, event_type, t, {sr('CASE WHEN ps IS NULL OR ns IS NULL THEN 0 WHEN ps = ns THEN pv ELSE pv + (gt - ps) / (ns - ps) * (nv - pv) END', 'value', 3)} FROM b"""


@query("irregular_to_grid", GRID_SQL)
def irregular(spark, sf):
    seconds = (
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 86400 + F.hour("ts") * 3600
        + F.minute("ts") * 60 + F.expr("extract(SECOND FROM ts)").cast("double")
    )
    rows = table(spark, sf, "events").select("user_id", "event_type", seconds.alias("s"), "value")
    grid = irregular_to_grid(
        rows, ["user_id", "event_type"], "s", "value", start=86400.0, step=86400.0, n_steps=28
    )
    return grid.select("user_id", "event_type", "t", r("value", 3).alias("value"))


DX = "((c.z_ne + 2 * c.z_e + c.z_se) - (c.z_nw + 2 * c.z_w + c.z_sw)) / 80"
DY = "((c.z_sw + 2 * c.z_s + c.z_se) - (c.z_nw + 2 * c.z_n + c.z_ne)) / 80"


@query("terrain", f"""
WITH g AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, p_retailprice * (1 + p_size % 7) AS z FROM part),
c AS (SELECT g.row, g.col, n.z AS z_n, s.z AS z_s, w.z AS z_w, e.z AS z_e, nw.z AS z_nw, ne.z AS z_ne, sw.z AS z_sw, se.z AS z_se
  FROM g LEFT JOIN g n ON n.row = g.row - 1 AND n.col = g.col LEFT JOIN g s ON s.row = g.row + 1 AND s.col = g.col
  LEFT JOIN g w ON w.row = g.row AND w.col = g.col - 1 LEFT JOIN g e ON e.row = g.row AND e.col = g.col + 1
  LEFT JOIN g nw ON nw.row = g.row - 1 AND nw.col = g.col - 1 LEFT JOIN g ne ON ne.row = g.row - 1 AND ne.col = g.col + 1
  LEFT JOIN g sw ON sw.row = g.row + 1 AND sw.col = g.col - 1 LEFT JOIN g se ON se.row = g.row + 1 AND se.col = g.col + 1)
SELECT row, col, {sr(f'degrees(atan(sqrt(pow({DX}, 2) + pow({DY}, 2))))', 'slope', 4)},
       {sr(f'CASE WHEN {DX} IS NULL OR {DY} IS NULL THEN NULL WHEN degrees(atan2(-({DX}), {DY})) < 0 THEN degrees(atan2(-({DX}), {DY})) + 360 ELSE degrees(atan2(-({DX}), {DY})) END', 'aspect', 4)}
FROM c
""")
def terrain(spark, sf):
    idx = F.col("p_partkey")
    dem = table(spark, sf, "part").select(
        row_of(idx, 50).alias("row"), col_of(idx, 50).alias("col"),
        (F.col("p_retailprice") * (1 + F.col("p_size") % 7)).alias("elevation"),
    )
    return rounded(slope_aspect(dem, dx=10.0, dy=10.0), ["slope", "aspect"], 4)


@query("tile_terrain", """
WITH g AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS tile_id, (p_partkey // 2) // 25 AS row, (p_partkey // 2) % 25 AS col, p_retailprice * (1 + p_size % 7) AS z FROM part),
n AS (SELECT g.tile_id, g.row, g.col, h.row - g.row AS dr, h.col - g.col AS dc, h.z FROM g JOIN g h ON h.tile_id = g.tile_id AND abs(h.row - g.row) <= 1 AND abs(h.col - g.col) <= 1),
s AS (SELECT tile_id, row, col, count(*) AS k, sum(z * dc * (2 - abs(dr))) / 80 AS gx, sum(z * dr * (2 - abs(dc))) / 80 AS gy FROM n GROUP BY ALL)
SELECT tile_id, row, col, round(CASE WHEN k = 9 THEN degrees(atan(sqrt(gx * gx + gy * gy))) END, 4) + CAST(0 AS DOUBLE) AS slope,
  round(CASE WHEN k = 9 THEN CASE WHEN degrees(atan2(-gx, gy)) < 0 THEN degrees(atan2(-gx, gy)) + 360 ELSE degrees(atan2(-gx, gy)) END END, 4) + CAST(0 AS DOUBLE) AS aspect
FROM s""")
def tile_terrain(spark, sf):
    key = F.expr("p_partkey div 2")
    dem = table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b").alias("tile_id"),
        row_of(key, 25).alias("row"), col_of(key, 25).alias("col"),
        (F.col("p_retailprice") * (1 + F.col("p_size") % 7)).alias("elevation"),
    )
    return rounded(slope_aspect(dem, dx=10.0, dy=10.0, tile="tile_id"), ["slope", "aspect"], 4)
