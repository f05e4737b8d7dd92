"""Feature importance, feature-set ablation and learning-rate comparison with Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.functions.labels import in_top
from phenoframe.functions.losses import cross_entropy
from phenoframe.functions.masks import finite_or_null
from phenoframe.operators.evaluate import evaluation
from phenoframe.operators.sampling import oversample_balanced
from phenoframe.scale.bounds import materialised, small_table

FOREST_ROWS = 40_000  # rows of a task that fits a forest


def flatten(series: Column) -> Column:
    """Series as one flat feature array."""
    return F.flatten(series)


def spread(df: DataFrame, array: str, width: int, prefix: str) -> tuple[DataFrame, list[str]]:
    """Array entries as columns, for the assembler."""
    names = [f"{prefix}{i}" for i in range(width)]
    return df.withColumns({n: F.get(array, F.lit(i)) for i, n in enumerate(names)}), names


def importance(
    df: DataFrame, features: list[str], y: str, trees: int = 200, depth: int = 15, seed: int = 42,
    rows_per_task: int = FOREST_ROWS,
) -> DataFrame:
    """Relative importance of columns in a random forest: ``(name, importance)``.

    Every level of the forest passes over all rows, in the partitions they are given in, so a
    table that one file holds would stay with one core. Above ``rows_per_task`` rows they are
    dealt to as many tasks as that takes; not to more, because each task sends statistics of
    every open node. A row remembers its node in each tree from one level to the next.
    """
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(df).select("_x", y)
    tasks = -(-data.count() // rows_per_task)
    if tasks > 1:
        data = data.repartition(tasks)
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol=y, numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True
    )
    values = forest.fit(data).featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(features, values)]
    return df.sparkSession.createDataFrame(rows, "name string, importance double")


def metrics(scored: DataFrame, name: str, y: str, n_classes: int) -> DataFrame:
    """One row of test metrics from ``proba`` and ``prediction``."""
    extra = scored.agg(
        F.struct(
            F.avg(cross_entropy(F.col("proba"), F.col(y))).alias("loss"),
            F.avg(in_top(F.col("proba"), F.col(y)).cast("int")).alias("top2"),
        )
    ).scalar()
    return (
        evaluation(scored, y, "prediction", n_classes)
        .withColumn("_e", extra)
        .select(
            F.lit(name).alias("config"), "accuracy", "kappa", "f1_macro", "f1_weighted",
            F.col("_e.loss").alias("loss"), F.col("_e.top2").alias("top2"),
        )
    )


def ablation(
    df: DataFrame, configs: dict[str, list[str]], y: str, n_classes: int, *, split: str = "split",
    evaluate_on: str = "test", classifier: Estimator | None = None, weight: str | None = None,
) -> DataFrame:
    """Same rows, split and classifier for every feature set; one row of metrics each."""
    results = []
    for name, features in configs.items():
        data = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
        model = (classifier or LogisticRegression(maxIter=20, regParam=1e-3)).copy()
        model = model.setFeaturesCol("_x").setLabelCol(y)
        if weight is not None:
            model = model.setWeightCol(weight)
        keep = ["_x", y] + ([weight] if weight else [])
        fitted = model.fit(data.where(F.col(split) == "train").select(*keep))
        scored = fitted.transform(data.where(F.col(split) == evaluate_on).select("_x", y))
        scored = scored.withColumn("proba", vector_to_array("probability"))
        results.append(metrics(scored, name, y, n_classes))
    return reduce(lambda a, b: a.unionByName(b), results)


def gaussian_ablation(
    df: DataFrame, configs: dict[str, list[str]], y: str, *, split: str = "split", evaluate_on: str = "test", eps: float = 1e-6
) -> DataFrame:
    """Every feature set judged by a Gaussian classifier in closed form.

    One aggregation gives count, mean and variance of every feature per class of the training rows, from
    which all feature sets are fitted, and one pass over the other rows scores them all. The
    likelihood of a class counts features once each, scaled by their own variance (plus
    ``eps``), so nothing needs standardising; missing and non-finite values say nothing. Of equal
    classes the smaller wins. Returns ``(config, n_rows, accuracy, recall_macro)``.
    """
    features = list(dict.fromkeys(f for names in configs.values() for f in names))
    rows = df.where(F.col(y).isNotNull()).select(
        F.col(y).alias("y"), F.col(split).alias("_split"), F.array(*[finite_or_null(F.col(f).cast("double")) for f in features]).alias("x")
    )
    value = [F.get("x", F.lit(i)) for i in range(len(features))]
    fitted = rows.where(F.col("_split") == "train").groupBy("y").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.struct(F.avg(v).alias("m"), (F.var_pop(v) + F.lit(eps)).alias("v")) for v in value]).alias("stats"),
    )
    table = small_table(fitted).agg(F.array_sort(F.collect_list(F.struct("y", "n", "stats")))).scalar()

    def term(x: Column, s: Column) -> Column:
        gap = x - s["m"]
        return F.coalesce(-gap * gap / (F.lit(2.0) * s["v"]) - F.ln(s["v"]) / 2, F.lit(0.0))

    held = rows.where(F.col("_split") == evaluate_on).withColumn("_t", table)
    held = held.select(
        "y",
        F.transform(
            "_t", lambda c: F.struct(c["y"].alias("y"), F.ln(c["n"]).alias("prior"), F.zip_with("x", c["stats"], term).alias("terms"))
        ).alias("_c"),
    )

    def best(names: list[str]) -> Column:
        at = F.array(*[F.lit(features.index(f)) for f in names]).cast("array<int>")
        total = lambda c: F.aggregate(at, c["prior"], lambda s, i: s + F.get(c["terms"], i))
        ranked = F.transform("_c", lambda c: F.struct(total(c).alias("score"), (-c["y"]).alias("less")))
        return -F.array_max(ranked)["less"]

    told = F.explode(F.array(*[F.struct(F.lit(n).alias("config"), best(f).alias("y_pred")) for n, f in configs.items()]))
    per_class = held.select("y", told.alias("p")).groupBy("p.config", "y").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p.y_pred") == F.col("y")).alias("hit")
    )
    return per_class.groupBy("config").agg(
        F.sum("n").alias("n_rows"), (F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("recall_macro")
    )


def compare_rates(
    df: DataFrame, features: list[str], y: str, n_classes: int, ids: list[str], *,
    rates: tuple[float, ...] = (1e-3, 5e-4), epochs: int = 6, hidden: int = 32, split: str = "split",
    seed: int = 42, patience: int = 3, balance: bool = True,
) -> DataFrame:
    """Least validation loss per learning rate: ``(rate, val_loss, best_epoch, epochs)``.

    Each pass over the training rows starts from the weights of the one before, and the loss is taken
    after each; a rate ends when its loss has not fallen for ``patience`` passes. With
    ``balance`` training rows are drawn until all classes are as frequent as the largest, as
    balanced class weights would have it.
    """
    rows = df.select(*ids, *features, y, split)
    train = rows.where(F.col(split) == "train")
    if balance:
        train = oversample_balanced(train, y, ids)
    assembler = VectorAssembler(inputCols=features, outputCol="_x")
    train = materialised(assembler.transform(train).select("_x", y))
    held = materialised(assembler.transform(rows.where(F.col(split) == "val")).select("_x", y))
    found = []
    for rate in rates:
        weights, best, best_epoch, epoch = None, float("inf"), 0, 0
        while epoch < epochs and epoch - best_epoch < patience:
            net = MultilayerPerceptronClassifier(
                featuresCol="_x", labelCol=y, layers=[len(features), hidden, n_classes], solver="gd",
                stepSize=rate, maxIter=1, seed=seed,
            )
            if weights is not None:
                net = net.setInitialWeights(weights)
            model = net.fit(train)
            scored = model.transform(held).withColumn("proba", vector_to_array("probability"))
            loss = scored.agg(F.avg(cross_entropy(F.col("proba"), F.col(y)))).first()[0]
            weights, epoch = model.weights, epoch + 1
            if loss is not None and loss < best:
                best, best_epoch = loss, epoch
        found.append((float(rate), None if best_epoch == 0 else float(best), best_epoch, epoch))
    return df.sparkSession.createDataFrame(found, "rate double, val_loss double, best_epoch int, epochs int")
