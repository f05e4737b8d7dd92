"""Missing values, validity masks and non-finite numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def finite_or_null(x: Column) -> Column:
    """Non-finite values become null, so that aggregates skip them."""
    return F.when(is_finite(x), x)


def finite_or_zero(x: Column) -> Column:
    """Non-finite values become zero."""
    return F.when(is_finite(x), x).otherwise(F.lit(0.0))


def sanitise_series(series: Column) -> Column:
    """Non-finite values of a series become zero."""
    return F.transform(series, lambda step: F.transform(step, finite_or_zero))


def nodata_to_null(x: Column, nodata) -> Column:
    """The nodata value of a raster becomes null."""
    return F.nullif(x, F.lit(nodata))


def binarise(m: Column) -> Column:
    """A mask value above one half is valid; a missing one is not."""
    return F.coalesce(m, F.lit(0)) > F.lit(0.5)


def valid_steps(series: Column, rule: str = "any_finite", eps: float = 1e-6, missing=0.0) -> Column:
    """Valid steps of a series by one of four rules.

    ``any_finite``: some channel has a value. ``any_above_eps``: some channel lies more than
    ``eps`` from zero. ``any_nonzero``: some channel is not zero. ``finite_not_missing``:
    some channel is finite and not the missing value.
    """
    rules = {
        "any_finite": lambda x: x.isNotNull() & ~F.isnan(x),
        "any_above_eps": lambda x: F.abs(F.coalesce(x, F.lit(0.0))) > F.lit(eps),
        "any_nonzero": lambda x: F.coalesce(x, F.lit(0.0)) != F.lit(0.0),
        "finite_not_missing": lambda x: is_finite(x) & (x != F.lit(float(missing))),
    }
    test = rules[rule]
    return F.transform(series, lambda step: F.coalesce(F.exists(step, test), F.lit(False)))


def mask_or_derived(mask: Column, derived: Column) -> Column:
    """The given mask when any step is valid, else the one derived from the data."""
    return F.when(F.exists(mask, lambda m: m), mask).otherwise(derived)


def ensure_one_valid(mask: Column) -> Column:
    """Mark the first step valid when no step is."""
    return F.when(F.exists(mask, lambda m: m), mask).otherwise(
        F.transform(mask, lambda _, i: i == 0)
    )


def count_valid(mask: Column) -> Column:
    """Number of valid steps."""
    return F.size(F.filter(mask, lambda m: m))


def pooled_mean(values: Column, mask: Column, denominator: str = "at_least_one") -> Column:
    """Mean of one channel over the valid steps.

    ``at_least_one`` divides by max(1, n), ``epsilon`` by n + 1e-6.
    """
    kept = F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: z["m"])
    total = F.aggregate(kept, F.lit(0.0), lambda acc, z: acc + z["v"])
    n = F.size(kept)
    return total / (F.greatest(n, F.lit(1)) if denominator == "at_least_one" else n + F.lit(1e-6))


def pooled_max(values: Column, mask: Column, fill: float = -1e9) -> Column:
    """Maximum of one channel over the valid steps, ``fill`` when there are none."""
    kept = F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(F.lit(fill)))
    return F.array_max(kept)
