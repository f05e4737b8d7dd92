"""Ten-day bins, resampling grids and time axes."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phenoframe.schemas import N_STEPS, STEP_DAYS


def decadal_bin(
    day: Column, n_bins: int = N_STEPS, bin_days: int = STEP_DAYS, tail: str = "clamp"
) -> Column:
    """Bin of the day of year. The days after the last bin join it, or become null."""
    raw = F.floor((F.dayofyear(day) - 1) / bin_days).cast("int")
    if tail == "clamp":
        return F.when(raw.isNotNull(), F.least(raw, F.lit(n_bins - 1)))
    if tail == "drop":
        return F.when(raw < n_bins, raw)
    raise ValueError(f"unknown tail: {tail}")


def bin_start(year: Column, number: Column, bin_days: int = STEP_DAYS) -> Column:
    """First date of a bin of a year."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (number * bin_days).cast("int"))


def bin_bounds(spark: SparkSession, n_bins: int = N_STEPS, bin_days: int = STEP_DAYS) -> DataFrame:
    """Bins with their half-open day-of-year bounds."""
    start = (F.col("id") * bin_days + 1).cast("int")
    return spark.range(n_bins).select(
        F.col("id").cast("int").alias("bin"),
        start.alias("start_doy"),
        (start + bin_days).alias("end_doy"),
    )


def spaced(first: float, last: float, n: int) -> list[float]:
    """``n`` evenly spaced numbers from ``first`` to ``last``."""
    if n == 1:
        return [first]
    step = (last - first) / (n - 1)
    return [first + i * step for i in range(n - 1)] + [last]


def _times(n_in: int, t_obs) -> list[float]:
    if n_in < 1:
        raise ValueError("at least one input step is needed")
    times = spaced(0.0, 1.0, n_in) if t_obs is None else [float(t) for t in t_obs]
    if len(times) != n_in:
        raise ValueError("one time per input step is needed")
    return times


def linear_grid(n_in: int, n_out: int, t_obs=None) -> list[tuple[int, float]]:
    """Left neighbour and weight of the right one for each output step."""
    if n_out < 1:
        raise ValueError("at least one output step is needed")
    times = _times(n_in, t_obs)
    if n_in == 1:
        return [(0, 0.0)] * n_out
    if times[-1] - times[0] < 1e-12:
        return [(n_in - 1, 0.0)] * n_out
    grid = []
    for t in spaced(times[0], times[-1], n_out):
        left = min(max(bisect_right(times, t) - 1, 0), n_in - 2)
        width = times[left + 1] - times[left]
        share = (t - times[left]) / width if width >= 1e-12 else 0.0
        grid.append((left, min(max(share, 0.0), 1.0)))
    return grid


def nearest_grid(n_in: int, n_out: int, t_obs=None) -> list[int]:
    """Nearest input step of each output step, the first one on a tie."""
    times = _times(n_in, t_obs)
    return [
        min(range(n_in), key=lambda i: (abs(times[i] - t), i))
        for t in spaced(times[0], times[-1], n_out)
    ]


def resample_linear(series: Column, n_in: int, n_out: int, t_obs=None) -> Column:
    """Linear interpolation of every channel onto ``n_out`` even steps."""
    grid = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"), F.lit(min(i + 1, n_in - 1)).alias("j"), F.lit(a).alias("a")
            )
            for i, a in linear_grid(n_in, n_out, t_obs)
        ]
    )
    return F.transform(
        grid,
        lambda g: F.zip_with(
            F.get(series, g["i"]),
            F.get(series, g["j"]),
            lambda x, y: (F.lit(1.0) - g["a"]) * x + g["a"] * y,
        ),
    )


def resample_mask_nearest(mask: Column, n_in: int, n_out: int, t_obs=None) -> Column:
    """Nearest-step value of a mask on ``n_out`` even steps."""
    picks = F.array(*[F.lit(i) for i in nearest_grid(n_in, n_out, t_obs)])
    return F.transform(picks, lambda i: F.get(mask, i))


def step_day(t: Column, n_steps: int = N_STEPS, variant: str = "step") -> Column:
    """Day of year shown for a step: ``(t+1)*10``, or even spacing from 10 to 360."""
    if variant == "step":
        return (t + 1) * STEP_DAYS
    if variant == "even":
        return F.lit(10.0) + t * F.lit(350.0 / (n_steps - 1))
    raise ValueError(f"unknown variant: {variant}")


def acquisition_date(name: Column) -> Column:
    """Acquisition date in a scene name; an error when there is none."""
    stamped = F.nullif(F.regexp_extract(name, r"_(\d{8})T\d{6}_", 1), F.lit(""))
    digits = F.nullif(F.regexp_extract(name, r"(\d{8})", 1), F.lit(""))
    found = F.coalesce(stamped, digits)
    return F.when(found.isNotNull(), F.to_date(found, "yyyyMMdd")).otherwise(
        F.raise_error(F.concat(F.lit("no acquisition date in "), name)).cast("date")
    )
