"""Reproducible augmentation of training series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.scale.ranks import gaussian, stable_hash, uniform


def _noisy(step: Column, t: Column, valid: Column, ident: list[Column], seed, sd: float) -> Column:
    def shifted(x: Column, c: Column) -> Column:
        return x + gaussian(stable_hash(f"{seed}n", *ident, t, c)) * F.lit(sd)

    return step if sd == 0 else F.when(valid, F.transform(step, shifted)).otherwise(step)


def drop_steps_and_jitter(
    samples: DataFrame, ids: list[str], n_steps: int, *, p: float = 0.3, low: float = 0.1,
    high: float = 0.2, sd: float = 0.005, seed: int = 42, series: str = "series", mask: str = "mask",
) -> DataFrame:
    """With probability ``p`` zero a share of the steps and add noise to the valid ones.

    The share is drawn between ``low`` and ``high``, at least one step. The mask stays.
    """
    ident = [F.col(i) for i in ids]
    row = stable_hash(seed, *ident)
    share = F.lit(low) + uniform(row, 1) * F.lit(high - low)
    k = F.greatest(F.lit(1), F.rint(F.lit(float(n_steps)) * share).cast("int"))
    steps = F.transform(
        F.sequence(F.lit(0), F.lit(n_steps - 1)),
        lambda t: F.struct(stable_hash(seed, *ident, t).alias("h"), t.alias("t")),
    )
    dropped = F.transform(F.slice(F.array_sort(steps), F.lit(1), k), lambda s: s["t"])
    chosen = samples.withColumn("_hit", uniform(row) <= F.lit(p)).withColumn("_drop", dropped)

    def changed(step: Column, t: Column) -> Column:
        kept = F.when(
            F.array_contains("_drop", t), F.transform(step, lambda x: F.lit(0.0))
        ).otherwise(step)
        return _noisy(kept, t, F.get(F.col(mask), t), ident, seed, sd)

    value = F.when(F.col("_hit"), F.transform(series, changed)).otherwise(F.col(series))
    return chosen.withColumn(series, value).drop("_hit", "_drop")


def mask_steps_and_jitter(
    samples: DataFrame, ids: list[str], *, rate: float = 0.05, sd: float = 0.02, seed: int = 42,
    series: str = "series", mask: str = "mask",
) -> DataFrame:
    """Noise on valid steps, then every step is dropped with probability ``rate``.

    Dropped steps become 0 and invalid.
    """
    ident = [F.col(i) for i in ids]

    def keep(t: Column) -> Column:
        return uniform(stable_hash(seed, *ident, t)) > F.lit(rate)

    def changed(step: Column, t: Column) -> Column:
        noisy = _noisy(step, t, F.get(F.col("_m0"), t), ident, seed, sd)
        return F.when(F.get(F.col("_keep"), t), noisy).otherwise(
            F.transform(step, lambda x: F.lit(0.0))
        )

    kept = samples.withColumn("_m0", F.col(mask)).withColumn(
        "_keep", F.transform(mask, lambda _, t: keep(t))
    )
    return kept.withColumns(
        {
            series: F.transform(series, changed),
            mask: F.zip_with(F.col("_m0"), F.col("_keep"), lambda m, k: m & k),
        }
    ).drop("_m0", "_keep")
