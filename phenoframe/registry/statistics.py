"""Composites, distributions, missing data, correlations, scaling and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.functions import masks
from phenoframe.functions.arrays import channel
from phenoframe.functions.labels import class_name
from phenoframe.functions.spectral import ndvi
from phenoframe.operators import audit, scaling
from phenoframe.operators.composite import climate_aggregate, decadal_composite, series_to_long
from phenoframe.operators.correlate import pearson_matrix, spearman_matrix
from phenoframe.operators.filters import clear_scenes
from phenoframe.operators.gapfill import fill_gaps
from phenoframe.registry.base import query, r, rounded, sr
from phenoframe.registry.roles import (
    BANDS, COMP, DENSE, OBS, PIXEL, PTS, TENSOR, TENSOR_CHANNELS, composites, dense, observations, pixel_labels, pixels,
    points, samples, table, tensors, with_ctes,
)
from phenoframe.scale.bounds import materialised
from phenoframe.schemas import CALIFORNIA_CLASSES, CLIMATE, COVARIATES, SOIL, TOPO


@query("decadal_median_composite", with_ctes(OBS, COMP, body="SELECT * FROM comp"))
def decadal(spark, sf):
    return composites(spark, sf)


@query("composite_one_year", with_ctes(
    OBS.replace("FROM lineitem", "FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND dayofyear(l_shipdate) <= 360"),
    COMP.replace("count(COALESCE(green, red, nir, swir)) > 0", "count(green) > 0"), body="SELECT * FROM comp"))
def composite_one_year(spark, sf):
    clear = clear_scenes(observations(spark, sf))
    return decadal_composite(
        clear, ["pixel_id"], "obs_date", BANDS, year=1997, tail="drop", mask_rule="green"
    )


@query("composite_dense", with_ctes(OBS, COMP, DENSE, body="""
SELECT pixel_id, year, t, COALESCE(green, 0) AS green, COALESCE(red, 0) AS red, COALESCE(nir, 0) AS nir,
       COALESCE(swir, 0) AS swir, valid FROM dense"""))
def composite_dense(spark, sf):
    return series_to_long(samples(spark, sf, empty=0.0), ["pixel_id", "year"], BANDS)


@query("composite_mask", with_ctes(OBS, body="""
SELECT pixel_id, CAST(year(obs_date) AS INT) AS year, CAST(least((dayofyear(obs_date) - 1) // 10, 35) AS INT) AS bin,
       count(COALESCE(green, swir)) > 0 AS any_band, count(green) > 0 AS green_band
FROM obs GROUP BY ALL"""))
def composite_mask(spark, sf):
    rows = observations(spark, sf)
    masks = {"any_band": "any", "green_band": "green"}
    made = decadal_composite(rows, ["pixel_id"], "obs_date", ["green", "swir"], masks=masks)
    return made.select("pixel_id", "year", "bin", *masks)


@query("phenology_curve", with_ctes(OBS, COMP, PIXEL, body=f"""
SELECT y, bin AS t, {sr('avg((nir - red) / (nir + red + 1e-6))', 'mean')},
       {sr('stddev_pop((nir - red) / (nir + red + 1e-6))', 'std')}, count(*) AS n
FROM comp c JOIN pixel p ON p.pixel_id = c.pixel_id GROUP BY y, bin"""))
def phenology_curve(spark, sf):
    labels = pixel_labels(spark, sf)
    rows = composites(spark, sf).join(labels, "pixel_id").select(
        "y", F.col("bin").alias("t"), ndvi(F.col("nir"), F.col("red")).alias("ndvi")
    )
    return rounded(audit.phenology(rows, "y", "t", "ndvi"), ["mean", "std"])


@query("phenology_interpolated", with_ctes(OBS, COMP, DENSE, PIXEL, f"""idx AS (
  SELECT pixel_id, year, t, CASE WHEN nir + red = 0 THEN 0 ELSE (nir - red) / (nir + red) END AS v FROM dense),
ends AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS pt, last_value(v IGNORE NULLS) OVER p AS pv,
    first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER n AS nt, first_value(v IGNORE NULLS) OVER n AS nv FROM idx
  WINDOW p AS (PARTITION BY pixel_id, year ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         n AS (PARTITION BY pixel_id, year ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
full_v AS (SELECT pixel_id, t, CASE WHEN pt IS NULL THEN 0 WHEN nt IS NULL OR pt = nt THEN pv ELSE pv + (t - pt) / (nt - pt) * (nv - pv) END AS v FROM ends)""",
body=f"""SELECT y, t, {sr('avg(v)', 'mean')}, {sr('stddev_pop(v)', 'std')}, count(v) AS n
FROM full_v f JOIN pixel p ON p.pixel_id = f.pixel_id GROUP BY y, t"""))
def phenology_interpolated(spark, sf):
    rows = dense(spark, sf).select(
        "pixel_id", "year", "t", ndvi(F.col("nir"), F.col("red"), "zero").alias("ndvi")
    )
    filled = fill_gaps(rows, ["pixel_id", "year"], "t", ["ndvi"], edge="leading_zero")
    labels = pixel_labels(spark, sf)
    return rounded(audit.phenology(filled.join(labels, "pixel_id"), "y", "t", "ndvi"), ["mean", "std"])


@query("seasonal_mean", with_ctes(OBS, COMP, body=f"""
SELECT pixel_id, year, {sr('avg((nir - red) / (nir + red + 1e-6))', 'ndvi_mean')} FROM comp GROUP BY pixel_id, year"""))
def seasonal_mean(spark, sf):
    rows = samples(spark, sf)
    index = F.transform("series", lambda s: ndvi(F.get(s, F.lit(2)), F.get(s, F.lit(1))))
    return rows.select("pixel_id", "year", r(audit.seasonal_mean(index)).alias("ndvi_mean"))


@query("class_distribution", with_ctes(PTS, body=f"""
SELECT z.zone, CAST(c.y AS INT) AS y, count(p.id) AS n, {sr('count(p.id) * 100.0 / any_value(z.total)', 'percent', 4)}
FROM (SELECT zone, count(*) AS total FROM pts GROUP BY zone) z CROSS JOIN range(6) c(y)
LEFT JOIN pts p ON p.zone = z.zone AND p.y = c.y GROUP BY z.zone, c.y"""))
def class_distribution(spark, sf):
    classes = spark.range(6).select(F.col("id").cast("int").alias("y"))
    out = audit.class_distribution(points(spark, sf), "y", ["zone"], classes)
    return rounded(out, ["percent"], 4)


@query("class_share", with_ctes(PTS, body=f"""
SELECT y, count(*) AS n, {sr('count(*) * 100.0 / (SELECT count(*) FROM pts)', 'percent', 4)} FROM pts GROUP BY y"""))
def class_share(spark, sf):
    return rounded(audit.class_distribution(points(spark, sf), "y"), ["percent"], 4)


@query("class_names", f"""
SELECT CASE c_nationkey {' '.join(f"WHEN {k} THEN '{v}'" for k, v in CALIFORNIA_CLASSES.items())} ELSE 'Class ' || c_nationkey END AS name,
       count(*) AS n, {sr('count(*) * 100.0 / (SELECT count(*) FROM customer)', 'percent', 4)} FROM customer GROUP BY c_nationkey""")
def class_names(spark, sf):
    counts = audit.class_distribution(table(spark, sf, "customer"), "c_nationkey")
    named = counts.select(class_name(F.col("c_nationkey"), CALIFORNIA_CLASSES).alias("name"), "n", "percent")
    return rounded(named, ["percent"], 4)


@query("top_codes", """
SELECT l_suppkey AS code, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, code LIMIT 15
""")
def top_codes(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"))
    return audit.top_codes(rows, "code")


@query("frequency_histogram", """
SELECT p_size AS code, count(*) AS n FROM part GROUP BY p_size
""")
def frequency(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_size").alias("code")).agg(F.count(F.lit(1)).alias("n"))


MISS = """flags AS (SELECT pixel_id, year, t, CASE WHEN valid THEN 0.0 ELSE 1.0 END AS gone FROM dense)"""


@query("missing_by_sample", with_ctes(OBS, COMP, DENSE, MISS, body=f"""
SELECT pixel_id, year, {sr('avg(gone)', 'missing_rate')} FROM flags GROUP BY pixel_id, year"""))
def missing_by_sample(spark, sf):
    return rounded(audit.missing_by_sample(samples(spark, sf), ["pixel_id", "year"]), ["missing_rate"])


@query("missing_by_step", with_ctes(OBS, COMP, DENSE, MISS, body=f"""
SELECT t, {sr('avg(gone)', 'missing_rate')} FROM flags GROUP BY t"""))
def missing_by_step(spark, sf):
    return rounded(audit.missing_by_step(samples(spark, sf)), ["missing_rate"])


@query("missing_summary", with_ctes(OBS, COMP, DENSE, MISS, """per AS (
  SELECT avg(gone) AS m FROM flags GROUP BY pixel_id, year), step AS (SELECT avg(gone) AS m FROM flags GROUP BY t)""", body=f"""
SELECT {sr('avg(m)', 'sample_mean')}, {sr('min(m)', 'sample_min')}, {sr('max(m)', 'sample_max')},
       {sr('(SELECT avg(m) FROM step)', 'step_mean')} FROM per"""))
def missing_summary(spark, sf):
    out = audit.missing_summary(samples(spark, sf))
    return rounded(out, out.columns)


@query("histogram", f"""
WITH v AS (SELECT l_extendedprice AS v, min(l_extendedprice) OVER () AS a, max(l_extendedprice) OVER () AS z FROM lineitem)
SELECT CAST(least(floor((v - a) / ((z - a) / 30)) + 1, 30) AS INT) AS bucket,
       {sr('any_value(a + (least(floor((v - a) / ((z - a) / 30)) + 1, 30) - 1) * ((z - a) / 30))', 'lower', 4)},
       {sr('any_value(a + least(floor((v - a) / ((z - a) / 30)) + 1, 30) * ((z - a) / 30))', 'upper', 4)}, count(*) AS n
FROM v GROUP BY 1
""")
def histogram(spark, sf):
    return rounded(audit.histogram(table(spark, sf, "lineitem"), "l_extendedprice"), ["lower", "upper"], 4)


@query("valid_step_stats", with_ctes(OBS, COMP, body=f"""
SELECT year, {sr('avg(n)', 'mean_valid')}, CAST(min(n) AS INT) AS min_valid, CAST(max(n) AS INT) AS max_valid
FROM (SELECT pixel_id, year, count(CASE WHEN valid THEN 1 END) AS n FROM comp GROUP BY pixel_id, year) GROUP BY year"""))
def valid_step_stats(spark, sf):
    return rounded(audit.valid_step_stats(samples(spark, sf), ["year"]), ["mean_valid"])


@query("null_audit", with_ctes(OBS, body="""
SELECT name, n_missing, n_rows FROM (SELECT count(*) AS n_rows, count(*) - count(green) AS green, count(*) - count(red) AS red,
  count(*) - count(nir) AS nir, count(*) - count(swir) AS swir FROM obs) UNPIVOT (n_missing FOR name IN (green, red, nir, swir))"""))
def null_audit(spark, sf):
    return audit.missing_values(observations(spark, sf), BANDS)


@query("series_null_audit", with_ctes(TENSOR, body="""
SELECT label, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing, count(*) AS n_values FROM tensor GROUP BY label"""))
def series_null_audit(spark, sf):
    return tensors(spark, sf).groupBy("label").agg(
        F.sum(audit.missing_in_series(F.col("series"))).alias("n_missing"),
        F.sum(F.size(F.flatten("series"))).alias("n_values"),
    )


@query("distinct_classes", with_ctes(PTS, body="SELECT DISTINCT y, zone FROM pts"))
def distinct_classes(spark, sf):
    return points(spark, sf).select("y", "zone").distinct()


@query("pearson_matrix", with_ctes(OBS, COMP, DENSE, """step AS (
  SELECT pixel_id, year, unnest(['green', 'red', 'nir', 'swir']) AS name,
         unnest([COALESCE(green, 0), COALESCE(red, 0), COALESCE(nir, 0), COALESCE(swir, 0)]) AS v FROM dense WHERE t = 12)""", body=f"""
SELECT a.name AS a, b.name AS b, {sr('corr(a.v, b.v)', 'corr', 5)} FROM step a JOIN step b ON a.pixel_id = b.pixel_id AND a.year = b.year
GROUP BY a.name, b.name"""))
def pearson(spark, sf):
    step = F.get("series", F.lit(12))
    rows = samples(spark, sf, empty=0.0).select(*[F.get(step, F.lit(i)).alias(b) for i, b in enumerate(BANDS)])
    return rounded(pearson_matrix(rows, BANDS), ["corr"], 5)


@query("spearman_matrix", f"""
WITH ranks AS (SELECT row_number() OVER () AS id,
  rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS l_quantity,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS l_extendedprice,
  rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS l_discount,
  rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0 AS l_tax FROM lineitem),
long AS (SELECT id, name, v FROM ranks UNPIVOT (v FOR name IN (l_quantity, l_extendedprice, l_discount, l_tax)))
SELECT a.name AS a, b.name AS b, {sr('corr(a.v, b.v)', 'corr', 5)} FROM long a JOIN long b ON a.id = b.id GROUP BY a.name, b.name
""")
def spearman(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(spearman_matrix(table(spark, sf, "lineitem"), columns), ["corr"], 5)


def split_samples(spark, sf):
    """Zero-filled samples; the first years train."""
    return samples(spark, sf, empty=0.0).withColumn(
        "split", F.when(F.col("year") <= 1999, "train").otherwise("test")
    )


LONG = """long AS (SELECT pixel_id, year, t, CAST(i AS INT) AS c, ['green', 'red', 'nir', 'swir'][i + 1] AS name,
  [COALESCE(green, 0), COALESCE(red, 0), COALESCE(nir, 0), COALESCE(swir, 0)][i + 1] AS v,
  CASE WHEN year <= 1999 THEN 'train' ELSE 'test' END AS split FROM dense, range(4) x(i))"""


@query("scaler_fit_channel", with_ctes(OBS, COMP, DENSE, LONG, body=f"""
SELECT c, name, {sr('avg(v)', 'mean')}, {sr('stddev_pop(v)', 'std')} FROM long WHERE split = 'train' GROUP BY c, name"""))
def scaler_fit_channel(spark, sf):
    fitted = scaling.fit_series_scaler(split_samples(spark, sf), BANDS)
    return rounded(fitted.drop("t"), ["mean", "std"])


@query("scaler_fit_step_channel", with_ctes(OBS, COMP, DENSE, LONG, body=f"""
SELECT t, c, name, {sr('avg(v)', 'mean')}, {sr('stddev_pop(v)', 'std')} FROM long WHERE split = 'train' GROUP BY t, c, name"""))
def scaler_fit_step(spark, sf):
    fitted = scaling.fit_series_scaler(split_samples(spark, sf), BANDS, per_step=True)
    return rounded(fitted, ["mean", "std"])


def _scaled(spark, sf, per_step):
    rows = materialised(split_samples(spark, sf))  # the fit and its use read one composite
    scaler = scaling.fit_series_scaler(rows, BANDS, per_step=per_step)
    scaled = scaling.apply_series_scaler(rows, scaler, per_step=per_step)
    long = series_to_long(scaled, ["pixel_id", "year"], BANDS)
    return rounded(long.drop("valid"), BANDS, 5)


def _scaled_sql(group: str, on: str) -> str:
    def pick(c: int, name: str) -> str:
        return sr(f"max(CASE WHEN l.c = {c} THEN (v - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END END)", name, 5)

    return with_ctes(OBS, COMP, DENSE, LONG, f"""fit AS (SELECT {group}, avg(v) AS mu, stddev_pop(v) AS sd FROM long
      WHERE split = 'train' GROUP BY {group})""", body=f"""
    SELECT l.pixel_id, l.year, l.t, {pick(0, 'green')}, {pick(1, 'red')}, {pick(2, 'nir')}, {pick(3, 'swir')}
    FROM long l JOIN fit f ON {on} GROUP BY l.pixel_id, l.year, l.t""")


@query("scaler_apply_channel", _scaled_sql("c", "f.c = l.c"))
def scaler_apply_channel(spark, sf):
    return _scaled(spark, sf, False)


@query("scaler_apply_step_channel", _scaled_sql("t, c", "f.t = l.t AND f.c = l.c"))
def scaler_apply_step(spark, sf):
    return _scaled(spark, sf, True)


@query("scaler_columns", f"""
WITH fit AS (SELECT avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2
  FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT c_custkey AS id, {sr('(c_acctbal - m1) / s1', 'c_acctbal')}, {sr('(c_nationkey - m2) / (s2 + 0)', 'c_nationkey')} FROM customer, fit
""")
def scaler_columns(spark, sf):
    columns = ["c_acctbal", "c_nationkey"]
    rows = table(spark, sf, "customer").withColumn(
        "split", F.when(F.col("c_mktsegment") != "BUILDING", "train").otherwise("test")
    )
    out = scaling.apply_column_scaler(rows, scaling.fit_column_scaler(rows, columns), columns)
    return rounded(out.select(F.col("c_custkey").alias("id"), *columns), columns)


@query("median_impute", with_ctes(OBS, body=f"""
, mid AS (SELECT median(green) AS g, median(swir) AS s FROM obs WHERE year(obs_date) <= 1999)
SELECT pixel_id, obs_date, {sr('sum(COALESCE(green, g))', 'green', 4)}, {sr('sum(COALESCE(swir, s))', 'swir', 4)}, count(*) AS n
FROM obs, mid GROUP BY pixel_id, obs_date"""))
def median_impute(spark, sf):
    rows = observations(spark, sf).withColumn(
        "split", F.when(F.year("obs_date") <= 1999, "train").otherwise("test")
    )
    out = scaling.impute_median(rows, ["green", "swir"])
    return out.groupBy("pixel_id", "obs_date").agg(
        r(F.sum("green"), 4).alias("green"), r(F.sum("swir"), 4).alias("swir"), F.count(F.lit(1)).alias("n")
    )


@query("zero_impute", with_ctes(OBS, body=f"""
SELECT pixel_id, {sr('sum(COALESCE(green, 0))', 'green', 3)}, {sr('avg(COALESCE(swir, 0))', 'swir', 3)} FROM obs GROUP BY pixel_id"""))
def zero_impute(spark, sf):
    out = scaling.impute_zero(observations(spark, sf), ["green", "swir"])
    return out.groupBy("pixel_id").agg(r(F.sum("green"), 3).alias("green"), r(F.avg("swir"), 3).alias("swir"))


WEIGHTS = """cnt AS (SELECT y, count(*) AS n FROM pts GROUP BY y),
bal AS (SELECT y, n, (SELECT sum(n) FROM cnt) / ((SELECT count(*) FROM cnt) * n) AS w,
  CASE WHEN n < (SELECT median(n) FROM cnt) THEN CAST(1.3 AS DOUBLE) ELSE 1 END AS lift FROM cnt)"""


@query("class_weights", with_ctes(PTS, WEIGHTS, body=f"SELECT y, n, {sr('w', 'weight')} FROM bal"))
def class_weights(spark, sf):
    return rounded(scaling.class_weights(points(spark, sf), "y", split=None), ["weight"])


@query("minority_boost", with_ctes(PTS, WEIGHTS, body=f"SELECT y, n, {sr('w * lift', 'weight')} FROM bal"))
def minority_boost(spark, sf):
    return rounded(scaling.class_weights(points(spark, sf), "y", split=None, boost=1.3), ["weight"])


@query("sample_weights", with_ctes(PTS, WEIGHTS, body=f"""
SELECT id, p.y, {sr('w * lift / ((SELECT avg(w * lift) FROM pts JOIN bal USING (y)) + 1e-8)', 'sample_weight')} FROM pts p JOIN bal b ON p.y = b.y"""))
def sample_weights(spark, sf):
    rows = points(spark, sf).select("id", "y")
    weights = scaling.class_weights(rows, "y", split=None, boost=1.3)
    return rounded(scaling.sample_weights(rows, "y", weights), ["sample_weight"])


@query("masked_pooling", with_ctes(TENSOR, """m AS (
  SELECT vec_id, t, COALESCE(max(CASE WHEN c = 0 THEN x END), 0) AS v, count(x) = 4 AS ok FROM tensor GROUP BY vec_id, t)""", body=f"""
SELECT vec_id, {sr('COALESCE(sum(CASE WHEN ok THEN v END), 0) / greatest(1, count(CASE WHEN ok THEN 1 END))', 'mean_one')},
       {sr('COALESCE(sum(CASE WHEN ok THEN v END), 0) / (count(CASE WHEN ok THEN 1 END) + 1e-6)', 'mean_eps')},
       {sr('max(CASE WHEN ok THEN v ELSE -1e9 END)', 'maximum')} FROM m GROUP BY vec_id"""))
def masked_pooling(spark, sf):
    full = F.transform("series", lambda s: F.forall(s, lambda x: x.isNotNull()))
    first = F.transform(channel(F.col("series"), 0), lambda x: F.coalesce(x, F.lit(0.0)))
    rows = tensors(spark, sf).select("vec_id", first.alias("v"), full.alias("m"))
    v, m = F.col("v"), F.col("m")
    return rows.select(
        "vec_id", r(masks.pooled_mean(v, m)).alias("mean_one"),
        r(masks.pooled_mean(v, m, "epsilon")).alias("mean_eps"), r(masks.pooled_max(v, m)).alias("maximum"),
    )


COV = """cov AS (SELECT c_custkey AS id, c_acctbal AS elevation, c_nationkey AS slope, c_custkey % 360 AS aspect,
  c_acctbal / 100 AS clay, c_acctbal / 200 AS sand, 100 - c_acctbal / 100 - c_acctbal / 200 AS silt, c_nationkey / 3 AS ph,
  c_custkey / 50 AS temp_max, c_custkey / 80 AS temp_min, c_custkey % 17 AS precip_sum FROM customer)"""


def covariates(spark, sf):
    key, bal, nat = F.col("c_custkey"), F.col("c_acctbal"), F.col("c_nationkey")
    values = {
        "elevation": bal, "slope": nat, "aspect": key % 360, "clay": bal / 100, "sand": bal / 200,
        "silt": 100 - bal / 100 - bal / 200, "ph": nat / 3, "temp_max": key / 50, "temp_min": key / 80,
        "precip_sum": key % 17,
    }
    columns = [values[c].cast("double").alias(c) for c in COVARIATES]
    return table(spark, sf, "customer").select(key.alias("id"), *columns)


SETS = {"topo": TOPO, "soil": SOIL, "climate": CLIMATE, "all": COVARIATES}


@query("feature_sets", with_ctes(COV, body=" UNION ALL ".join(
    f"SELECT '{name}' AS feature_set, id, {sr(' + '.join(cols), 'total', 4)} FROM cov" for name, cols in SETS.items())))
def feature_sets(spark, sf):
    rows = covariates(spark, sf)
    parts = []
    for name, columns in SETS.items():
        chosen = rows.select("id", *columns)
        total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
        parts.append(chosen.select(F.lit(name).alias("feature_set"), "id", r(total, 4).alias("total")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("summary_report", """
WITH codes AS (SELECT s_nationkey AS code, count(*) AS n FROM supplier GROUP BY 1 ORDER BY n DESC, code LIMIT 15)
SELECT r.*, codes.code, codes.n, (SELECT string_agg(y || ':' || n, ',' ORDER BY y) FROM (
    SELECT n_regionkey AS y, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)) AS class_counts
FROM (SELECT count(*) AS n_rows, count(DISTINCT s_nationkey) AS n_codes,
  count(DISTINCT n_regionkey) AS n_classes FROM supplier JOIN nation ON s_nationkey = n_nationkey) r, codes
""")
def summary_report(spark, sf):
    report = audit.summary_report(pixels(spark, sf), "y", "code")
    pairs = F.transform(F.array_sort(F.map_entries("class_counts")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    flat = report.select(
        "n_rows", "n_codes", "n_classes", F.array_join(pairs, ",").alias("class_counts"), F.explode("top_codes").alias("c")
    )
    return flat.select("n_rows", "n_codes", "n_classes", "class_counts", F.col("c.code").cast("int").alias("code"), F.col("c.n").alias("n"))


# Line items in which some measures are not a number or infinite: those are missing.
ODD = """odd AS (
  SELECT l_suppkey AS id, l_linenumber AS y, l_orderkey % 9 AS t, CAST(l_shipdate AS DATE) AS day,
    CASE l_linenumber WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE l_quantity END AS a,
    CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS b,
    CASE WHEN l_orderkey % 7 = 1 THEN NULL ELSE l_discount END AS c FROM lineitem)"""


def odd_rows(spark, sf):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("id"), line.alias("y"), (order % 9).alias("t"), F.col("l_shipdate").cast("date").alias("day"),
        F.when(line == 3, nan).when(line == 4, None).otherwise(F.col("l_quantity")).alias("a"),
        F.when(order % 5 == 0, F.when(order % 2 == 0, -inf).otherwise(nan)).otherwise(F.col("l_extendedprice")).alias("b"),
        F.when(order % 7 == 1, nan).otherwise(F.col("l_discount")).alias("c"),
    )


@query("pearson_missing", with_ctes(ODD, body="""""" + " UNION ALL ".join(
    f"SELECT '{i}' AS a, '{j}' AS b, {sr(f'corr({i}, {j})', 'corr', 5)} FROM odd" for i in "abc" for j in "abc")))
def pearson_missing(spark, sf):
    return rounded(pearson_matrix(odd_rows(spark, sf), ["a", "b", "c"]), ["corr"], 5)


@query("histogram_missing", with_ctes(ODD, body=f"""
, lim AS (SELECT min(b) AS lo, max(b) AS hi FROM odd)
SELECT bucket, {sr('any_value(lo) + (bucket - 1) * (any_value(hi) - any_value(lo)) / 12', 'lower', 3)},
  {sr('any_value(lo) + bucket * (any_value(hi) - any_value(lo)) / 12', 'upper', 3)}, count(*) AS n
FROM (SELECT lo, hi, CAST(least(floor((b - lo) / ((hi - lo) / 12)) + 1, 12) AS INT) AS bucket FROM odd, lim WHERE b IS NOT NULL) GROUP BY bucket"""))
def histogram_missing(spark, sf):
    return rounded(audit.histogram(odd_rows(spark, sf), "b", 12), ["lower", "upper"], 3)


@query("phenology_missing", with_ctes(ODD, body=f"""
SELECT y, t, {sr('avg(b)', 'mean', 3)}, {sr('stddev_pop(b)', 'std', 3)}, count(b) AS n FROM odd GROUP BY y, t"""))
def phenology_missing(spark, sf):
    return rounded(audit.phenology(odd_rows(spark, sf), "y", "t", "b"), ["mean", "std"], 3)


@query("scaler_missing", with_ctes(ODD, body=" UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS c, '{c}' AS name, {sr(f'avg({c})', 'mean', 4)}, {sr(f'stddev_pop({c})', 'std', 4)} FROM odd" for i, c in enumerate("abc"))))
def scaler_missing(spark, sf):
    return rounded(scaling.fit_column_scaler(odd_rows(spark, sf), ["a", "b", "c"], split=None), ["mean", "std"], 4)


@query("climate_missing", with_ctes(ODD, body=f"""
SELECT id, {sr('avg(a)', 'temp_max', 4)}, {sr('avg(c)', 'temp_min', 4)}, {sr('sum(b)', 'precip_sum', 2)}
FROM odd WHERE day >= DATE '1995-01-01' AND day < DATE '1996-01-01' GROUP BY id"""))
def climate_missing(spark, sf):
    found = climate_aggregate(odd_rows(spark, sf), "id", "day", "1995-01-01", "1996-01-01", "a", "c", "b")
    return found.select("id", r("temp_max", 4).alias("temp_max"), r("temp_min", 4).alias("temp_min"), r("precip_sum", 2).alias("precip_sum"))
