"""Hand-worked values of the column functions."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from phenoframe.functions import geo, labels, losses, masks, spectral, temporal
from phenoframe.functions.arrays import append_mask_channel, permute_axes, repeat_static
from phenoframe.functions.gaps import fill_channel

NAN = float("nan")


def value(spark, column, **inputs):
    row = spark.range(1)
    for name, v in inputs.items():
        row = row.withColumn(name, F.lit(None).cast("double") if v is None else F.lit(v))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x, want", [(2500.0, 0.25), (0.3, 0.3), (-0.1, 0.0), (1.2, 1.0), (None, None)])
def test_reflectance(spark, x, want):
    got = value(spark, spectral.reflectance(F.col("x")), x=x)
    assert got == want if want is None else got == pytest.approx(want)


def test_ndvi_zero_denominator(spark):
    for variant in ("epsilon", "zero", "clipped"):
        assert value(spark, spectral.ndvi(F.col("n"), F.col("r"), variant), n=0.0, r=0.0) == 0


def test_ndvi_clipped_uses_reflectance(spark):
    got = value(spark, spectral.ndvi(F.col("n"), F.col("r"), "clipped"), n=6000.0, r=2000.0)
    assert got == pytest.approx(0.5)


@pytest.mark.parametrize(
    "edge, values, want",
    [
        ("hold", [None, 2.0, None, 4.0, None], [2, 2, 3, 4, 4]),
        ("leading_zero", [None, 2.0, None, 4.0, None], [0, 2, 3, 4, 4]),
        ("fill", [None, 2.0, None, 4.0, None], [0, 2, 3, 4, 0]),
        ("fill", [1.0, None, 4.0], [1, 2.5, 4]),
        ("hold", [None, None], [0, 0]),
    ],
)
def test_fill_channel(spark, edge, values, want):
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(fill_channel(F.col("v"), edge)).first()[0] == want


def test_fill_channel_by_mask_leaves_empty_series(spark):
    df = spark.createDataFrame([([5.0, 9.0, 7.0], [True, False, True]), ([5.0, 9.0, 7.0], [False] * 3)], "v array<double>, m array<boolean>")
    got = [r[0] for r in df.select(fill_channel(F.col("v"), mask=F.col("m"))).collect()]
    assert got == [[5, 6, 7], [5, 9, 7]]


def test_fill_channel_has_no_longest_series(spark):
    df = spark.createDataFrame([([1.0] + [None] * 363 + [2.0],)], "v array<double>")
    got = df.select(fill_channel(F.col("v"))).first()[0]
    assert got[0] == 1 and got[364] == 2 and got[182] == pytest.approx(1.5)


def test_fill_channel_takes_nan_as_missing(spark):
    df = spark.createDataFrame([([float("nan"), 2.0, float("nan"), 4.0, float("inf")],)], "v array<double>")
    assert df.select(fill_channel(F.col("v"))).first()[0] == [2, 2, 3, 4, 4]


def test_unknown_label_and_date_stay_unknown(spark):
    df = spark.createDataFrame([(None, None)], "y int, d date")
    row = df.select(labels.clip_label(F.col("y"), 5), temporal.decadal_bin(F.col("d"))).first()
    assert tuple(row) == (None, None)


def test_resample_linear(spark):
    df = spark.createDataFrame([([[0.0], [2.0], [4.0]],)], "s array<array<double>>")
    got = df.select(temporal.resample_linear(F.col("s"), 3, 5)).first()[0]
    assert got == [[0], [1], [2], [3], [4]]


def test_resample_single_and_degenerate_steps(spark):
    df = spark.createDataFrame([([[7.0]], [[1.0], [3.0]])], "a array<array<double>>, b array<array<double>>")
    row = df.select(
        temporal.resample_linear(F.col("a"), 1, 3), temporal.resample_linear(F.col("b"), 2, 3, [5, 5])
    ).first()
    assert row[0] == [[7], [7], [7]]
    assert row[1] == [[3], [3], [3]]


def test_resample_with_observed_times(spark):
    df = spark.createDataFrame([([[0.0], [10.0], [20.0]],)], "s array<array<double>>")
    got = df.select(temporal.resample_linear(F.col("s"), 3, 3, [0, 1, 10])).first()[0]
    assert [round(v[0], 6) for v in got] == [0, round(10 + 10 * 4 / 9, 6), 20]


def test_nearest_mask_takes_the_first_on_a_tie(spark):
    df = spark.createDataFrame([([True, False, True],)], "m array<boolean>")
    got = df.select(temporal.resample_mask_nearest(F.col("m"), 3, 5)).first()[0]
    assert got == [True, True, False, False, True]


@pytest.mark.parametrize("day, clamp, drop", [("2023-01-01", 0, 0), ("2023-12-26", 35, 35), ("2023-12-31", 35, None)])
def test_decadal_bin(spark, day, clamp, drop):
    d = F.lit(day).cast("date")
    row = spark.range(1).select(temporal.decadal_bin(d), temporal.decadal_bin(d, tail="drop")).first()
    assert (row[0], row[1]) == (clamp, drop)


def test_acquisition_date(spark):
    names = ["S2A_MSIL2A_20250601T162901_N0.SAFE", "scene_20240229.SAFE"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [str(r[0]) for r in df.select(temporal.acquisition_date(F.col("n"))).collect()]
    assert got == ["2025-06-01", "2024-02-29"]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("none",)], "n string").select(temporal.acquisition_date(F.col("n"))).collect()


def test_code_61_in_the_three_mappings(spark):
    row = spark.range(1).select(
        *[labels.code_class(F.lit(61), v) for v in ("arkansas_60", "arkansas_61", "arkansas")]
    ).first()
    assert list(row) == [None, 4, 4]


def test_code_class_of_other_codes(spark):
    row = spark.range(1).select(
        labels.code_class(F.lit(176), "arkansas_60"), labels.code_class(F.lit(176), "arkansas"),
        labels.code_class(F.lit(204), "california"), labels.code_class(F.lit(1), "california"),
    ).first()
    assert list(row) == [None, 4, 4, 5]


def test_eligible_rounds_half_to_even(spark):
    row = spark.range(1).select(
        labels.eligible(F.lit(5), F.lit(95.0), F.lit(40.5)), labels.eligible(F.lit(5), F.lit(95.0), F.lit(39.5)),
        labels.eligible(F.lit(5), F.lit(94.9), F.lit(40.0)), labels.eligible(F.lit(0), F.lit(99.0), F.lit(40.0)),
    ).first()
    assert list(row) == [True, True, False, False]


def test_argmax_and_top_two(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4], 2), ([0.5, 0.3, 0.2], 2)], "p array<double>, y int")
    rows = df.select(labels.argmax_class(F.col("p")), labels.in_top(F.col("p"), F.col("y"))).collect()
    assert [tuple(r) for r in rows] == [(1, True), (0, False)]


def test_losses(spark):
    df = spark.createDataFrame([([0.25, 0.75], 0)], "p array<double>, y int")
    p, y = F.col("p"), F.col("y")
    row = df.select(losses.cross_entropy(p, y), losses.focal(p, y, 2.0, 0.25), losses.smoothed_cross_entropy(p, y, 2, 0.1)).first()
    assert row[0] == pytest.approx(-math.log(0.25))
    assert row[1] == pytest.approx(0.25 * 0.75**2 * -math.log(0.25))
    assert row[2] == pytest.approx(-(0.95 * math.log(0.25) + 0.05 * math.log(0.75)))


def test_masks(spark):
    series = [[NAN, None], [0.0, 0.0], [1e-9, 0.0], [0.5, None]]
    df = spark.createDataFrame([(series,)], "s array<array<double>>")
    s = F.col("s")
    row = df.select(*[masks.valid_steps(s, r) for r in ("any_finite", "any_above_eps", "any_nonzero", "finite_not_missing")]).first()
    assert row[0] == [False, True, True, True]
    assert row[1][1:] == [False, False, True]
    assert row[3] == [False, False, True, True]


def test_mask_fallbacks_and_pooling(spark):
    df = spark.createDataFrame([([False, False], [True, False], [3.0, 5.0])], "m array<boolean>, d array<boolean>, v array<double>")
    row = df.select(
        masks.mask_or_derived(F.col("m"), F.col("d")), masks.ensure_one_valid(F.col("m")),
        masks.pooled_mean(F.col("v"), F.col("m")), masks.pooled_mean(F.col("v"), F.col("d")),
        masks.pooled_max(F.col("v"), F.col("d")), masks.pooled_max(F.col("v"), F.col("m")),
    ).first()
    assert list(row) == [[True, False], [True, False], 0.0, 3.0, 3.0, -1e9]


def test_sanitise_and_nan_median(spark):
    df = spark.createDataFrame([([[NAN, float("inf")], [1.0, None]],)], "s array<array<double>>")
    assert df.select(masks.sanitise_series(F.col("s"))).first()[0] == [[0, 0], [1, 0]]
    rows = spark.createDataFrame([(NAN,), (1.0,), (3.0,)], "v double")
    assert rows.agg(F.median(masks.finite_or_null(F.col("v")))).first()[0] == 2


def test_series_shapes(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [True, False])], "s array<array<double>>, m array<boolean>")
    row = df.select(
        permute_axes(F.col("s"), 2), append_mask_channel(F.col("s"), F.col("m")), repeat_static(F.col("s"), [F.lit(9)]),
        spectral.append_indices(F.col("s"), ["r", "n"], "r", "r", "n"),
    ).first()
    assert row[0] == [[1, 3], [2, 4]]
    assert row[1] == [[1, 2, 1], [3, 4, 0]]
    assert row[2] == [[1, 2, 9], [3, 4, 9]]
    assert [len(s) for s in row[3]] == [4, 4]


def test_points_and_areas(spark):
    df = spark.createDataFrame([('{"type":"Point","coordinates":[-121.5,38.9]}',)], "g string")
    assert tuple(df.select(geo.parse_point(F.col("g"))).first()[0]) == (-121.5, 38.9)
    bad = spark.createDataFrame([('{"type":"Line","coordinates":[1,2]}',)], "g string")
    with pytest.raises(PySparkException):
        bad.select(geo.parse_point(F.col("g"))).collect()
    west, south, east, north = geo.buffer_bounds(-121.5, 38.9, 2500)
    assert west < -121.5 < east and south < 38.9 < north
    assert (north - south) * 111.2 == pytest.approx(5.0, abs=0.02)


def test_class_name(spark):
    from phenoframe.functions.labels import class_name

    df = spark.createDataFrame([(0,), (7,), (None,)], "y int")
    assert [r[0] for r in df.select(class_name(F.col("y"), {0: "Corn"})).collect()] == ["Corn", "Class 7", None]
