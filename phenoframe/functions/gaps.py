"""Linear interpolation between bracketing values, and gap filling inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from phenoframe.functions.arrays import channel
from phenoframe.functions.masks import finite_or_null


def between(t: Column, before: Column, after: Column) -> Column:
    """Value at ``t`` on the line through two points."""
    width = after["t"] - before["t"]
    share = (t - before["t"]) / width
    return F.when(width == 0, before["v"]).otherwise(
        before["v"] + share * (after["v"] - before["v"])
    )


def bracketed(
    t: Column, before: Column, after: Column, edge: str, fill: float, empty: Column
) -> Column:
    """Value at ``t`` from the points around it.

    Outside the valid range ``edge`` decides: ``hold`` the nearest value, ``fill`` with a
    constant, or ``leading_zero`` (0 before the range, hold after it).
    """
    leading = {"hold": after["v"], "fill": F.lit(fill), "leading_zero": F.lit(0.0)}[edge]
    trailing = {"hold": before["v"], "fill": F.lit(fill), "leading_zero": before["v"]}[edge]
    return (
        F.when(before.isNull() & after.isNull(), empty)
        .when(before.isNull(), leading)
        .when(after.isNull(), trailing)
        .otherwise(between(t, before, after))
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value several times inside array functions, computing it once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fill_channel(
    values: Column, edge: str = "hold", fill: float = 0.0, mask: Column | None = None
) -> Column:
    """Gap-filled values of one channel held as an array of steps.

    Null and non-finite steps, and with ``mask`` the invalid ones, are interpolated. A channel without
    valid steps becomes 0, or with ``mask`` stays as it was. The valid points are listed
    once and searched by halving for every step.
    """

    def point(v: Column, t: Column) -> Column:
        return F.struct(t.cast("double").alias("t"), v.cast("double").alias("v"))

    if mask is None:
        points = F.transform(values, lambda v, t: F.when(finite_or_null(v).isNotNull(), point(v, t)))
    else:
        kept = F.zip_with(values, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m")))
        points = F.transform(
            kept, lambda k, t: F.when(k["m"] & finite_or_null(k["v"]).isNotNull(), point(k["v"], t))
        )
    # the steps of a search over as many valid points as there are
    halves = F.filter(F.array(*[F.lit(1 << k) for k in reversed(range(31))]), lambda h: h <= F.size(values))

    def filled(row: Column) -> Column:
        known, halves = row["known"], row["halves"]

        def step(v: Column, i: Column) -> Column:
            t = i.cast("double")
            upto = F.aggregate(
                halves,
                F.lit(0),
                lambda n, h: F.when(F.get(known, n + h - 1)["t"] <= t, n + h).otherwise(n),
            )
            empty = F.lit(0.0) if mask is None else v.cast("double")

            def value(n: Column) -> Column:
                before, after = F.get(known, n - 1), F.get(known, n)
                return F.when(before["t"] == t, before["v"]).otherwise(
                    bracketed(t, before, after, edge, fill, empty)
                )

            return bound(upto, value)

        return F.transform(row["values"], step)

    listed = F.filter(points, lambda p: p.isNotNull())
    return bound(
        F.struct(listed.alias("known"), values.alias("values"), halves.alias("halves")), filled
    )


def fill_series(
    series: Column, n_channels: int, edge: str = "hold", fill: float = 0.0,
    mask: Column | None = None,
) -> Column:
    """Gap-filled ``series[t][c]``; needs no other row, hence no shuffle."""
    channels = [
        fill_channel(channel(series, c), edge, fill, mask).alias(f"c{c}")
        for c in range(n_channels)
    ]
    # Zipping evaluates every channel once; steps then only pick from the zipped row.
    return F.transform(
        F.arrays_zip(*channels), lambda z: F.array(*[z[f"c{c}"] for c in range(n_channels)])
    )
