"""Classifier evaluation from predicted classes and probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoframe.functions.labels import in_top


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str, n_classes: int) -> DataFrame:
    """Counts of every (true, predicted) pair and their share of the true class.

    Labels or predictions outside 0..n-1, unknown ones too, stay as pairs of their own, so that
    they count as wrong wherever rows are counted.
    """
    counts = df.groupBy(
        F.col(y_true).cast("bigint").alias("y_true"), F.col(y_pred).cast("bigint").alias("y_pred")
    ).agg(F.count(F.lit(1)).alias("_n"))
    grid = df.sparkSession.range(n_classes * n_classes).select(
        F.floor(F.col("id") / n_classes).alias("y_true"), F.pmod("id", F.lit(n_classes)).alias("y_pred")
    )
    zeros = grid.withColumn("_n", F.lit(0).cast("bigint"))
    dense = counts.unionByName(zeros).groupBy("y_true", "y_pred").agg(F.sum("_n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("y_true"))
    return dense.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def marginals(confusion: DataFrame) -> DataFrame:
    """Hits, support and predictions per class: ``(class_id, tp, support, predicted)``."""
    own = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y_true").alias("class_id"), own.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("y_pred").alias("class_id"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    return (
        confusion.select(F.explode(sides).alias("s"))
        .select("s.*")
        .groupBy("class_id")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )


def _agreement() -> list[Column]:
    po = F.col("tp") / F.col("n")
    pe = F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return [po.alias("accuracy"), F.when(pe != 1, (po - pe) / (1 - pe)).alias("kappa")]


def accuracy_kappa(confusion: DataFrame) -> DataFrame:
    """Overall accuracy and agreement beyond chance in one row."""
    n = F.sum("support")
    sums = marginals(confusion).agg(
        F.sum("tp").alias("tp"), n.alias("n"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("chance"),
    )
    return sums.select(*_agreement())


def class_report(confusion: DataFrame, eps: float = 0.0) -> DataFrame:
    """Hits, precision, recall, F1 and support per class; a zero divisor gives 0.

    With ``eps`` the divisors are raised by it instead, as a running metric does.
    """
    e = F.lit(eps)

    def ratio(a, b):
        return F.when(b + e > 0, a / (b + e)).otherwise(F.lit(0.0))

    tp = F.col("tp")
    scored = marginals(confusion).select(
        "class_id", "tp", "support", "predicted",
        ratio(tp, F.col("predicted")).alias("precision"), ratio(tp, F.col("support")).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", ratio(2 * p * r, p + r))


def f1_scores(confusion: DataFrame) -> DataFrame:
    """Macro F1 over the classes that occur, and F1 weighted by support."""
    rows = class_report(confusion).where(F.col("support") + F.col("predicted") > 0)
    return rows.agg(
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def macro_f1_metric(confusion: DataFrame, eps: float = 1e-7) -> DataFrame:
    """Mean F1 over all classes with ``eps`` in every divisor."""
    return class_report(confusion, eps).agg(F.avg("f1").alias("macro_f1"))


def top_k_accuracy(df: DataFrame, proba: str, y: str, k: int = 2) -> DataFrame:
    """Share of rows whose true class is among the ``k`` best."""
    return df.agg(F.avg(in_top(F.col(proba), F.col(y), k).cast("int")).alias(f"top{k}_accuracy"))


def mean_loss(df: DataFrame, loss: str, weight: str | None = None) -> DataFrame:
    """Average loss, optionally weighted."""
    if weight is None:
        return df.agg(F.avg(loss).alias("loss"))
    return df.agg((F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)).alias("loss"))


def evaluation(df: DataFrame, y_true: str, y_pred: str, n_classes: int) -> DataFrame:
    """Accuracy, kappa and F1 scores in one row."""
    report = class_report(confusion_matrix(df, y_true, y_pred, n_classes))
    occurs = F.col("support") + F.col("predicted") > 0
    n = F.sum("support")
    sums = report.agg(
        F.sum("tp").alias("tp"), n.alias("n"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("chance"),
        F.avg(F.when(occurs, F.col("f1"))).alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
    )
    return sums.select(*_agreement(), "f1_macro", "f1_weighted")


def best_epochs(log: DataFrame, config: str = "config", epoch: str = "epoch", loss: str = "val_loss",
                accuracy: str = "val_accuracy") -> DataFrame:
    """Epoch with the lowest validation loss per configuration, the first one on a tie."""
    best = F.min(F.struct(F.col(loss), F.col(epoch), F.col(accuracy))).alias("_b")
    return log.where(F.col(loss).isNotNull()).groupBy(config).agg(best).select(
        config,
        F.col(f"_b.{epoch}").alias("best_epoch"),
        F.col(f"_b.{loss}").alias("best_val_loss"),
        F.col(f"_b.{accuracy}").alias("best_val_accuracy"),
    )


def ranking(df: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    """Configurations ranked by one metric; a table of a few rows."""
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    return df.withColumn("rank", F.rank().over(Window.orderBy(order)))
