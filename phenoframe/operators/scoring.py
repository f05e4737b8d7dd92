"""Batch scoring of pixel series with any model that predicts on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F, types as T

from phenoframe.functions.labels import argmax_class


def score(
    df: DataFrame, features: Column, width: int, load_model: Callable, out: str = "proba",
    batch_size: int = 1024,
) -> DataFrame:
    """Class probabilities of flat feature arrays.

    ``load_model()`` runs once per Python worker and returns ``predict(batch)``, which maps
    an array of shape (n, width) to probabilities of shape (n, classes). Rows stay in their
    partitions; batches travel as Arrow.
    """
    predict = predict_batch_udf(
        load_model,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return df.withColumn(out, predict(features))


def linear_softmax(weights: list[list[float]], bias: list[float]) -> Callable:
    """A loader for a linear classifier with one weight row per class."""

    def load():
        import numpy as np

        w = np.asarray(weights, dtype="float64").T
        b = np.asarray(bias, dtype="float64")

        def predict(batch):
            logits = np.asarray(batch, dtype="float64") @ w + b
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return predict

    return load


def predicted(df: DataFrame, proba: str = "proba", label: str | None = None, out: str = "y_pred") -> DataFrame:
    """Predicted class, and whether it equals the label (null without a valid label)."""
    scored = df.withColumn(out, argmax_class(F.col(proba)))
    if label is None:
        return scored
    hit = F.when(F.col(label) >= 0, F.col(out) == F.col(label))
    return scored.withColumn("correct", hit)
