"""Preparation paths, batch scoring, model comparisons and the streaming composite."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F, types as T

from phenoframe.functions.arrays import channel
from phenoframe.functions.masks import finite_or_zero
from phenoframe.operators.augment import mask_steps_and_jitter
from phenoframe.operators.composite import monthly_radar, radar_columns, series_to_long
from phenoframe.operators.evaluate import evaluation
from phenoframe.operators.filters import clear_scenes
from phenoframe.operators.sampling import ratio_split
from phenoframe.operators.scaling import fit_series_scaler
from phenoframe.operators.scoring import linear_softmax, predicted, score
from phenoframe.plans import ablation as plan
from phenoframe.plans.inference import infer_map
from phenoframe.plans.preparation import (
    align_modalities, prepare_scenes, prepare_table, standardise_modalities,
)
from phenoframe.registry.base import query, r, rounded, sr
from phenoframe.registry.labelling import MONTHS, radar_obs
from phenoframe.registry.roles import (
    BANDS, COMP, DENSE, OBS, PIXEL, PRED, TENSOR, TENSOR_CHANNELS, TENSOR_STEPS, observations, observations_of, pixel_labels, pixels,
    samples,     table, tensors, with_ctes,
)
from phenoframe.registry.sampling import _word, FILLED, TOTAL, filled_tensors
from phenoframe.registry.statistics import COV, LONG, covariates, split_samples
from phenoframe.scale.bounds import new_folder
from phenoframe.schemas import COVARIATES
from phenoframe.streaming.composite import late_bins, run_available, stream_composite

N = 10
FIRST_TEN = [[5.0 if i == k else 0.0 for i in range(64)] for k in range(N)]
EVERY_STEP = [[5.0 if i % N == k else 0.0 for i in range(64)] for k in range(N)]  # all 16 steps count


@query("batch_scoring", with_ctes(PRED, body=f"""
SELECT vec_id, y_pred, {sr('list_max(proba)', 'confidence')} FROM pred"""))
def batch_scoring(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    scored = predicted(score(rows, F.col("x"), 64, linear_softmax(FIRST_TEN, [0.0] * N)))
    return scored.select("vec_id", "y_pred", r(F.array_max("proba")).alias("confidence"))


RATES = [0.0, 0.1, 0.2, 0.3]


@query("missing_step_robustness", with_ctes(TENSOR, FILLED, f"""rates AS (SELECT unnest({RATES}) AS rate),
kept AS (SELECT rate, vec_id, label, t * 4 + c AS i, CASE WHEN u > rate THEN x ELSE 0 END AS x FROM (
  SELECT f.vec_id, e.label, t, c, x, {_word("'42-' || f.vec_id || '-' || t", 0)} / {TOTAL} AS u
  FROM filled f JOIN embeddings e ON e.vec_id = f.vec_id), rates),
sums AS (SELECT rate, vec_id, label, i % 10 AS i, round(sum(x), 9) AS x FROM kept GROUP BY rate, vec_id, label, i % 10),
pred AS (SELECT rate, vec_id, any_value(label) AS y, arg_max(i, (x, -i)) AS y_pred FROM sums GROUP BY rate, vec_id),
cls AS (SELECT rate, c.i, count(CASE WHEN y = c.i THEN 1 END) AS s, count(CASE WHEN y_pred = c.i THEN 1 END) AS p FROM pred, range(10) c(i) GROUP BY rate, c.i),
chance AS (SELECT rate, sum(s * p) / (sum(s) * sum(s)) AS pe FROM cls GROUP BY rate),
acc AS (SELECT rate, avg(CASE WHEN y = y_pred THEN 1 ELSE 0 END) AS po FROM pred GROUP BY rate)""", body=f"""
SELECT CAST(acc.rate AS DOUBLE) AS rate, {sr('po', 'accuracy')}, {sr('(po - pe) / (1 - pe)', 'kappa')} FROM acc JOIN chance USING (rate)"""))
def robustness(spark, sf):
    rows = filled_tensors(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    results = []
    for rate in RATES:
        thinned = mask_steps_and_jitter(rows, ["vec_id"], rate=rate, sd=0.0)
        scored = score(thinned, F.flatten("series"), 64, linear_softmax(EVERY_STEP, [0.0] * N))
        scores = evaluation(predicted(scored), "label", "y_pred", N)
        results.append(scores.select(F.lit(rate).alias("rate"), r("accuracy").alias("accuracy"), r("kappa").alias("kappa")))
    return reduce(lambda a, b: a.unionByName(b), results)


def _filled(b: str) -> str:
    k = f"CASE WHEN {b} IS NOT NULL THEN t END"
    pt, pv = f"last_value({k} IGNORE NULLS) OVER p", f"last_value({b} IGNORE NULLS) OVER p"
    nt, nv = f"first_value({k} IGNORE NULLS) OVER n", f"first_value({b} IGNORE NULLS) OVER n"
    return f"""CASE WHEN {pt} IS NULL AND {nt} IS NULL THEN 0 WHEN {pt} IS NULL THEN {nv} WHEN {nt} IS NULL THEN {pv}
      WHEN {pt} = {nt} THEN {pv} ELSE {pv} + (t - {pt}) / ({nt} - {pt}) * ({nv} - {pv}) END AS {b}"""


PREPARED = f"""filled AS (SELECT d.pixel_id || '_' || year AS id, y, t, {', '.join(_filled(b) for b in BANDS)}
  FROM dense d JOIN pixel x ON x.pixel_id = d.pixel_id
  WINDOW p AS (PARTITION BY d.pixel_id, year ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         n AS (PARTITION BY d.pixel_id, year ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
placed AS (SELECT id, row_number() OVER (PARTITION BY y ORDER BY md5('42-' || id), id) AS rank FROM (SELECT DISTINCT id, y FROM filled)),
split AS (SELECT f.*, CASE WHEN rank <= 240 THEN 'train' WHEN rank <= 300 THEN 'val' ELSE 'test' END AS split FROM filled f JOIN placed USING (id)),
fit AS (SELECT {', '.join(f'avg({b}) AS m_{b}, stddev_pop({b}) AS s_{b}' for b in BANDS)} FROM split WHERE split = 'train')"""


@query("tabular_preparation", with_ctes(OBS, COMP, DENSE, PIXEL, PREPARED, body=f"""
SELECT id, y, split, {', '.join(sr(f'sum(({b} - m_{b}) / s_{b})', b, 5) for b in BANDS)} FROM split, fit GROUP BY id, y, split"""))
def tabular_preparation(spark, sf):
    labels = pixel_labels(spark, sf)
    rows = samples(spark, sf).join(labels, "pixel_id").select(
        F.concat_ws("_", F.col("pixel_id").cast("string"), F.col("year").cast("string")).alias("id"), "y", "series", "mask"
    )
    prepared, _ = prepare_table(rows, "id", "y", BANDS)

    def total(c: int):
        return F.aggregate(channel(F.col("series"), c), F.lit(0.0), lambda acc, x: acc + x)

    return prepared.select("id", "y", "split", *[r(total(i), 5).alias(b) for i, b in enumerate(BANDS)])


@query("scene_preparation", with_ctes(OBS, PIXEL, """picked AS (
  SELECT pixel_id, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42-' || pixel_id), pixel_id) AS rank FROM pixel) WHERE rank <= 12)""",
  COMP.replace("FROM obs WHERE", "FROM obs WHERE year(obs_date) = 1997 AND pixel_id IN (SELECT pixel_id FROM picked) AND"), body="""
SELECT p.pixel_id, p.y, p.t, COALESCE(green, 0) AS green, COALESCE(red, 0) AS red, COALESCE(nir, 0) AS nir, COALESCE(swir, 0) AS swir,
       COALESCE(valid, false) AS valid
FROM (SELECT pixel_id, y, CAST(unnest(range(36)) AS INT) AS t FROM picked) p LEFT JOIN comp c ON c.pixel_id = p.pixel_id AND c.bin = p.t"""))
def scene_preparation(spark, sf):
    labels = pixels(spark, sf).select("pixel_id", "y")
    rows = prepare_scenes(
        labels, observations(spark, sf), "pixel_id", "y", "obs_date", BANDS, year=1997, max_samples=60
    )
    return series_to_long(rows, ["pixel_id", "y"], BANDS)


def standardised(spark, sf, statics):
    """Aligned and standardised modalities of every vector with a customer's covariates."""
    rows = tensors(spark, sf).select(F.col("vec_id").alias("id"), F.col("label").alias("y"), "series")
    filled = F.transform("series", lambda s: F.transform(s, finite_or_zero))
    rows = rows.withColumn("series", filled)
    cov = covariates(spark, sf)
    radar = monthly_radar(radar_obs(spark, sf), "id", "day", fallback="pixel")
    aligned = align_modalities(
        rows, cov, statics, radar, n_in=TENSOR_STEPS, resample=12, mask_channel=True
    )
    return standardise_modalities(aligned, statics, channels=TENSOR_CHANNELS + 1)


@query("multimodal_preparation")
def multimodal_preparation(spark, sf):
    """One row per vector with some of its standardised values."""
    statics = ["elevation", "clay", "temp_max"]
    out = standardised(spark, sf, statics)
    return out.select("id", "y", "split", "vv_01", "ratio_12", *statics, F.flatten("series")[0].alias("first_value"))


# Every value of a vector under a name: resampled steps with their mask, radar months, covariates.
VALUES = f"""cell AS (SELECT vec_id AS id, t, c, COALESCE(x, 0) AS x, x IS NOT NULL AS known FROM tensor),
axis AS (SELECT k, CAST(least(floor(k * 15 / 11), 14) AS INT) AS i, k * 15 / 11 - least(floor(k * 15 / 11), 14) AS a,
  (SELECT min_by(j, (abs(j / 15 - k / 11), j)) FROM range(16) n(j)) AS j FROM range(12) g(k)),
named AS (
  SELECT l.id, 's_' || k || '_' || l.c AS name, (1 - a) * l.x + a * h.x AS v
  FROM axis JOIN cell l ON l.t = i JOIN cell h ON h.id = l.id AND h.c = l.c AND h.t = i + 1
  UNION ALL SELECT id, 's_' || k || '_4', CAST(bool_or(known) AS INT) FROM axis JOIN cell ON cell.t = axis.j GROUP BY id, k
  UNION ALL SELECT g.id, unnest(['ratio_', 'vh_', 'vv_']) || lpad(CAST(g.month AS VARCHAR), 2, '0'),
    unnest([COALESCE(m.vh, g.vh) - COALESCE(m.vv, g.vv), COALESCE(m.vh, g.vh), COALESCE(m.vv, g.vv)])
  FROM grid g LEFT JOIN monthly m ON m.id = g.id AND m.month = g.month
  UNION ALL SELECT id, unnest({COVARIATES}), unnest([{', '.join(COVARIATES)}]) FROM cov),
drawn AS (
  SELECT vec_id AS id, label AS y, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || vec_id), vec_id) AS rank,
         count(*) OVER (PARTITION BY label) AS n
  FROM embeddings WHERE vec_id IN (SELECT id FROM yearly) AND vec_id IN (SELECT id FROM cov)),
parted AS (
  SELECT id, y, CASE WHEN rank <= floor(n * CAST(0.15 AS DOUBLE) + 0.5) THEN 'test'
    WHEN rank <= floor(n * CAST(0.3 AS DOUBLE) + 0.5) THEN 'val' ELSE 'train' END AS split FROM drawn),
fitted AS (SELECT name, avg(v) AS mu, stddev_pop(v) AS sd FROM named JOIN parted USING (id) WHERE split = 'train' GROUP BY name)"""


@query("multimodal_values", with_ctes(TENSOR, MONTHS.format(where=""), COV, VALUES, body=f"""
SELECT id, y, split, name, {sr('(v - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END', 'value', 5)}
FROM parted JOIN named USING (id) JOIN fitted USING (name)"""))
def multimodal_values(spark, sf):
    """Every standardised value of every vector: series steps, radar months and covariates."""
    names = [*radar_columns(), *COVARIATES]
    out = standardised(spark, sf, COVARIATES)
    series = F.transform("series", lambda step, t: F.transform(step, lambda v, c: F.struct(
        F.concat_ws("_", F.lit("s"), t, c).alias("name"), v.cast("double").alias("value"))))
    plain = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    long = out.select("id", "y", "split", F.explode(F.concat(F.flatten(series), plain)).alias("e"))
    return rounded(long.select("id", "y", "split", "e.*"), ["value"], 5)


def feature_table(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("x")
    )
    split = ratio_split(rows, ["y"], ["id"])
    return split.select("id", "y", "split", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(64)])


OPTICAL = [f"x{i}" for i in range(40)]
RADAR = [f"x{i}" for i in range(40, 56)]
STATIC = [f"x{i}" for i in range(56, 64)]


@query("feature_importance")
def feature_importance(spark, sf):
    """Importance of static covariates for the customer segment."""
    rows = covariates(spark, sf).join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).cast("double").alias("y")), "id"
    )
    return plan.importance(rows, COVARIATES, "y")


@query("feature_ablation")
def feature_ablation(spark, sf):
    """Four feature sets with the same split, classifier and metrics."""
    configs = {
        "optical": OPTICAL,
        "optical_static": OPTICAL + STATIC,
        "optical_radar": OPTICAL + RADAR,
        "optical_radar_static": OPTICAL + RADAR + STATIC,
    }
    return plan.ablation(feature_table(spark, sf), configs, "y", N, classifier=LogisticRegression(maxIter=10, regParam=1e-3))


@query("learning_rates")
def learning_rates(spark, sf):
    """Validation loss per learning rate."""
    return plan.compare_rates(feature_table(spark, sf), OPTICAL + RADAR + STATIC, "y", N, ["id"], rates=(0.03, 0.3), epochs=6)


CLOSED_SETS = {"optical": range(40), "optical_static": [*range(40), *range(56, 64)], "optical_radar": range(56), "all": range(64)}


@query("closed_form_ablation", f"""
WITH placed AS (
  SELECT vec_id, label AS y, embedding, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || vec_id), vec_id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
split AS (
  SELECT vec_id, y, embedding, CASE WHEN rank <= floor(n * 0.15 + 0.5) THEN 'test' WHEN rank <= floor(n * 0.3 + 0.5) THEN 'val' ELSE 'train' END AS split FROM placed),
long AS (SELECT vec_id, y, split, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM split),
fit AS (SELECT y AS k, i, avg(x) AS m, var_pop(x) + 1e-6 AS v FROM long WHERE split = 'train' GROUP BY y, i),
prior AS (SELECT y AS k, ln(count(*)) AS prior FROM split WHERE split = 'train' GROUP BY y),
sets(config, i) AS ({' UNION ALL '.join(f"SELECT '{n}', unnest({list(f)})" for n, f in CLOSED_SETS.items())}),
score AS (
  SELECT vec_id, y, config, k, any_value(prior) + sum(-(x - m) * (x - m) / (2 * v) - ln(v) / 2) AS score
  FROM long JOIN fit USING (i) JOIN sets USING (i) JOIN prior USING (k) WHERE split = 'test' GROUP BY vec_id, y, config, k),
told AS (SELECT vec_id, y, config, arg_max(k, score) AS y_pred FROM score GROUP BY vec_id, y, config),
per AS (SELECT config, y, count(*) AS n, count(*) FILTER (y = y_pred) AS hit FROM told GROUP BY config, y)
SELECT config, CAST(sum(n) AS BIGINT) AS n_rows, {sr('sum(hit) / sum(n)', 'accuracy')}, {sr('avg(hit / n)', 'recall_macro')} FROM per GROUP BY config""")
def closed_form_ablation(spark, sf):
    """All feature sets fitted from one aggregation of the training rows."""
    configs = {n: [f"x{i}" for i in f] for n, f in CLOSED_SETS.items()}
    return rounded(plan.gaussian_ablation(feature_table(spark, sf), configs, "y"), ["accuracy", "recall_macro"])


@query("streaming_composite", with_ctes(OBS, COMP, body="""
SELECT pixel_id, year, bin, green, red, nir, swir, valid FROM comp
WHERE CAST(make_date(year, 1, 1) + 10 * bin AS DATE) <= (SELECT max(CAST(make_date(year, 1, 1) + 10 * bin AS DATE)) FROM comp) - 20"""))
def streaming_composite(spark, sf):
    source = f"{sf}/lineitem.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{sf}/lineitem*.parquet")
    obs = clear_scenes(observations_of(stream))
    composite = stream_composite(obs, ["pixel_id"], "obs_date", BANDS)
    out = new_folder(spark, "composites")
    run_available(composite, out, new_folder(spark, "progress")).awaitTermination()
    return spark.read.schema(composite.schema).parquet(out).drop("bin_time", "observations")


@query("streaming_late_rows", with_ctes(OBS, """timed AS (
  SELECT pixel_id, scl, CAST(year(obs_date) AS INT) AS year, CAST(least((dayofyear(obs_date) - 1) // 10, 35) AS INT) AS bin
  FROM obs WHERE scl <> 8),
started AS (SELECT *, CAST(make_date(year, 1, 1) + 10 * bin AS DATE) AS day FROM timed),
reached AS (SELECT max(day) - 20 AS day FROM started WHERE scl = 5)""", body="""
SELECT pixel_id, year, bin, count(*) AS n_late FROM started
WHERE scl = 4 AND day <= (SELECT day FROM reached) GROUP BY pixel_id, year, bin"""))
def streaming_late_rows(spark, sf):
    """Observations of scene class 4 arrive when those of class 5 have all been processed."""
    source, out, progress = (new_folder(spark, n) for n in ("arrivals", "composites", "progress"))
    rows = clear_scenes(observations(spark, sf))
    for arrival in (5, 4):
        rows.where(F.col("scl") == arrival).write.parquet(f"{source}/{arrival}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{source}/*")
        composite = stream_composite(stream, ["pixel_id"], "obs_date", BANDS)
        run_available(composite, out, progress).awaitTermination()
    made = spark.read.schema(composite.schema).parquet(out)
    arrived = spark.read.schema(rows.schema).parquet(f"{source}/*")
    return late_bins(arrived, made, ["pixel_id"], "obs_date").drop("bin_time")


# One class per band: its score is the mean standardised value of the band over the year.
BAND_WEIGHTS = [[1.0 / 36 if i < 144 and i % 4 == c else 0.0 for i in range(180)] for c in range(4)]


@query("map_inference", with_ctes(OBS, COMP, DENSE, PIXEL, LONG, """fit AS (
  SELECT c, avg(v) AS mu, stddev_pop(v) AS sd FROM long WHERE split = 'train' GROUP BY c),
score AS (SELECT pixel_id, year, c, avg((v - mu) / sd) AS s FROM long JOIN fit USING (c) GROUP BY pixel_id, year, c),
best AS (SELECT pixel_id, year, CAST(arg_max(c, s) AS INT) AS y_pred FROM score GROUP BY pixel_id, year)""", body="""
SELECT b.pixel_id, year, y_pred, CASE WHEN p.y <> 4 THEN y_pred = p.y END AS correct FROM best b JOIN pixel p ON p.pixel_id = b.pixel_id"""))
def map_inference(spark, sf):
    rows = split_samples(spark, sf)
    scaler = fit_series_scaler(rows, BANDS)
    labelled = rows.join(pixel_labels(spark, sf), "pixel_id").withColumn(
        "label", F.when(F.col("y") == 4, -9999).otherwise(F.col("y"))
    )
    loader = linear_softmax(BAND_WEIGHTS, [0.0] * 4)
    mapped = infer_map(labelled, scaler, loader, n_steps=36, n_channels=4, label="label")
    return mapped.select("pixel_id", "year", "y_pred", "correct")
