"""Small helpers for series held as ``array<array<double>>`` (``series[t][c]``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(values) -> Column:
    """A literal array of doubles."""
    return F.array(*[F.lit(float(v)) for v in values])


def channel(series: Column, index: int) -> Column:
    """One channel of a series over time."""
    return F.transform(series, lambda step: F.get(step, F.lit(index)))


def permute_axes(series: Column, n_channels: int) -> Column:
    """Time-major series to channel-major: ``out[c][t] = series[t][c]``."""
    return F.array(*[channel(series, c) for c in range(n_channels)])


def repeat_static(series: Column, statics: list[Column]) -> Column:
    """Append static values to the channels of every step."""
    fixed = F.array(*[s.cast("double") for s in statics])
    return F.transform(series, lambda step: F.concat(step, fixed))


def append_mask_channel(series: Column, mask: Column) -> Column:
    """Append the step mask as one more channel of 0 and 1."""
    flags = F.transform(mask, lambda m: F.array(m.cast("double")))
    return F.zip_with(series, flags, lambda step, flag: F.concat(step, flag))


def radar_tensor(ratio: list[Column], vh: list[Column], vv: list[Column]) -> Column:
    """Twelve monthly radar columns per channel as ``array<struct<ratio,vh,vv>>``."""
    return F.array(
        *[
            F.struct(r.alias("ratio"), h.alias("vh"), v.alias("vv"))
            for r, h, v in zip(ratio, vh, vv)
        ]
    )
