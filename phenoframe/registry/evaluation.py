"""Predictions, losses, confusion matrices and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.functions import losses
from phenoframe.functions.labels import argmax_class, in_top
from phenoframe.operators import evaluate
from phenoframe.operators.scaling import class_weights, sample_weights
from phenoframe.operators.scoring import predicted
from phenoframe.registry.base import query, r, rounded, sr
from phenoframe.registry.roles import PRED, predictions, table, with_ctes

CM = """cm AS (SELECT t.i AS y_true, p.i AS y_pred, count(pred.vec_id) AS n FROM range(10) t(i) CROSS JOIN range(10) p(i)
  LEFT JOIN pred ON pred.y = t.i AND pred.y_pred = p.i GROUP BY t.i, p.i),
marg AS (SELECT c.i AS class_id, (SELECT n FROM cm WHERE y_true = c.i AND y_pred = c.i) AS tp,
  (SELECT sum(n) FROM cm WHERE y_true = c.i)::BIGINT AS support, (SELECT sum(n) FROM cm WHERE y_pred = c.i)::BIGINT AS predicted FROM range(10) c(i)),
rep AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS q FROM marg),
report AS (SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f1 FROM rep)"""
N = 10


def confusion(spark, sf):
    return evaluate.confusion_matrix(predictions(spark, sf), "y", "y_pred", N)


@query("argmax_class", with_ctes(PRED, body="SELECT vec_id, y, y_pred FROM pred"))
def argmax(spark, sf):
    return predictions(spark, sf).select("vec_id", "y", argmax_class(F.col("proba")).alias("y_pred"))


@query("error_map", with_ctes(PRED, body="""
SELECT vec_id, y_pred, CASE WHEN y >= 2 THEN y_pred = y END AS correct FROM pred"""))
def error_map(spark, sf):
    rows = predictions(spark, sf).drop("y_pred").withColumn("label", F.when(F.col("y") >= 2, F.col("y")).otherwise(-9999))
    return predicted(rows, label="label").select("vec_id", "y_pred", "correct")


@query("confusion_matrix", with_ctes(PRED, CM, body=f"""
SELECT y_true, y_pred, n, {sr('CASE WHEN s > 0 THEN n / s ELSE 0 END', 'share')}
FROM (SELECT *, sum(n) OVER (PARTITION BY y_true) AS s FROM cm)"""))
def confusion_query(spark, sf):
    return rounded(confusion(spark, sf), ["share"])


@query("accuracy_kappa", with_ctes(PRED, CM, body=f"""
SELECT {sr('po', 'accuracy')}, {sr('(po - pe) / (1 - pe)', 'kappa')} FROM (
  SELECT sum(tp) / sum(support) AS po, sum(support * predicted) / (sum(support) * sum(support)) AS pe FROM marg)"""))
def accuracy_kappa(spark, sf):
    return rounded(evaluate.accuracy_kappa(confusion(spark, sf)), ["accuracy", "kappa"])


@query("class_report", with_ctes(PRED, CM, body=f"""
SELECT class_id, tp, support, predicted, {sr('p', 'precision')}, {sr('q', 'recall')}, {sr('f1', 'f1')} FROM report"""))
def class_report(spark, sf):
    return rounded(evaluate.class_report(confusion(spark, sf)), ["precision", "recall", "f1"])


@query("macro_f1", with_ctes(PRED, CM, body=f"""
SELECT {sr('avg(f1)', 'f1_macro')}, {sr('sum(f1 * support) / sum(support)', 'f1_weighted')} FROM report WHERE support + predicted > 0"""))
def macro_f1(spark, sf):
    return rounded(evaluate.f1_scores(confusion(spark, sf)), ["f1_macro", "f1_weighted"])


@query("macro_f1_metric", with_ctes(PRED, CM, body=f"""
SELECT {sr('avg(2 * pe * re / (pe + re + 1e-7))', 'macro_f1')} FROM (
  SELECT tp / (predicted + 1e-7) AS pe, tp / (support + 1e-7) AS re FROM marg)"""))
def macro_f1_metric(spark, sf):
    return rounded(evaluate.macro_f1_metric(confusion(spark, sf)), ["macro_f1"])


@query("top2_accuracy", with_ctes(PRED, body=f"""
SELECT {sr('avg(CASE WHEN len(list_filter(proba, lambda v: v > proba[y + 1])) < 2 THEN 1 ELSE 0 END)', 'top2_accuracy')} FROM pred"""))
def top2(spark, sf):
    return rounded(evaluate.top_k_accuracy(predictions(spark, sf), "proba", "y"), ["top2_accuracy"])


OWN = "least(greatest(proba[y + 1], 1e-7), CAST(1.0 - 1e-7 AS DOUBLE))"
LOSS = f"""loss AS (SELECT vec_id, y, -ln({OWN}) AS ce, pow(1 - {OWN}, 2) * -ln({OWN}) AS focal,
  pow(1 - {OWN}, 2) * -ln({OWN}) * 0.25 AS focal_alpha,
  -((1 - 0.08) * ln({OWN}) + 0.008 * list_sum(list_transform(proba, lambda v: ln(v)))) AS smoothed FROM pred)"""


def with_losses(spark, sf):
    rows = predictions(spark, sf)
    p, y = F.col("proba"), F.col("y")
    return rows.select(
        "vec_id", "y", losses.cross_entropy(p, y).alias("ce"), losses.focal(p, y).alias("focal"),
        losses.focal(p, y, alpha=0.25).alias("focal_alpha"),
        losses.smoothed_cross_entropy(p, y, N).alias("smoothed"),
    )


@query("losses", with_ctes(PRED, LOSS, body=f"""
SELECT vec_id, {sr('ce', 'ce')}, {sr('focal', 'focal')}, {sr('focal_alpha', 'focal_alpha')}, {sr('smoothed', 'smoothed')} FROM loss"""))
def loss_rows(spark, sf):
    return rounded(with_losses(spark, sf).drop("y"), ["ce", "focal", "focal_alpha", "smoothed"])


@query("mean_loss", with_ctes(PRED, LOSS, body=f"SELECT {sr('avg(focal)', 'loss')} FROM loss"))
def mean_loss(spark, sf):
    return rounded(evaluate.mean_loss(with_losses(spark, sf), "focal"), ["loss"])


@query("weighted_mean_loss", with_ctes(PRED, LOSS, """w AS (
  SELECT y, (SELECT count(*) FROM loss) / ((SELECT count(DISTINCT y) FROM loss) * count(*)) AS w FROM loss GROUP BY y)""", body=f"""
SELECT {sr('sum(ce * w) / sum(w)', 'loss')} FROM loss JOIN w ON w.y = loss.y"""))
def weighted_mean_loss(spark, sf):
    rows = with_losses(spark, sf)
    weighed = sample_weights(rows, "y", class_weights(rows, "y", split=None))
    return rounded(evaluate.mean_loss(weighed, "ce", "sample_weight"), ["loss"])


@query("evaluation_summary", with_ctes(PRED, CM, body=f"""
SELECT {sr('po', 'accuracy')}, {sr('(po - pe) / (1 - pe)', 'kappa')}, {sr('f', 'f1_macro')}, {sr('g', 'f1_weighted')} FROM (
  SELECT sum(tp) / sum(support) AS po, sum(support * predicted) / (sum(support) * sum(support)) AS pe,
         avg(f1) FILTER (WHERE support + predicted > 0) AS f, sum(f1 * support) / sum(support) AS g FROM report)"""))
def summary(spark, sf):
    out = evaluate.evaluation(predictions(spark, sf), "y", "y_pred", N)
    return rounded(out, out.columns)


LOG = """log AS (SELECT o_orderpriority || '/' || o_orderstatus AS config, o_orderkey AS epoch, o_totalprice AS val_loss,
  o_custkey / 1000 AS val_accuracy FROM orders),
best AS (SELECT config, epoch AS best_epoch, val_loss AS best_val_loss, val_accuracy AS best_val_accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY config ORDER BY val_loss, epoch) AS place FROM log) WHERE place = 1)"""


def metric_log(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("config"), F.col("o_orderkey").alias("epoch"),
        F.col("o_totalprice").alias("val_loss"), (F.col("o_custkey") / 1000).alias("val_accuracy"),
    )


@query("best_epoch", with_ctes(LOG, body="SELECT * FROM best"))
def best_epoch(spark, sf):
    return evaluate.best_epochs(metric_log(spark, sf))


@query("config_ranking", with_ctes(LOG, body="""
SELECT *, rank() OVER (ORDER BY best_val_accuracy DESC) AS rank FROM best"""))
def config_ranking(spark, sf):
    return evaluate.ranking(evaluate.best_epochs(metric_log(spark, sf)), "best_val_accuracy").withColumn(
        "rank", F.col("rank").cast("bigint")
    )
