"""Per-row losses of predicted class probabilities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-7


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS))


def cross_entropy(proba: Column, y: Column) -> Column:
    """Negative log of the true class probability."""
    return -F.ln(_clipped(F.get(proba, y)))


def smoothed_cross_entropy(proba: Column, y: Column, n_classes: int, smoothing: float = 0.08) -> Column:
    """Cross entropy against a target softened towards the uniform distribution."""
    share = F.lit(smoothing / n_classes)
    logs = F.aggregate(proba, F.lit(0.0), lambda acc, p: acc + F.ln(_clipped(p)))
    own = F.ln(_clipped(F.get(proba, y)))
    return -(F.lit(1.0 - smoothing) * own + share * logs)


def focal(proba: Column, y: Column, gamma: float = 2.0, alpha: float | None = None) -> Column:
    """Cross entropy that plays down confident rows."""
    p = _clipped(F.get(proba, y))
    loss = F.pow(F.lit(1.0) - p, F.lit(gamma)) * -F.ln(p)
    return loss if alpha is None else loss * F.lit(alpha)
