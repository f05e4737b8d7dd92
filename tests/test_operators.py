"""Operators on small tables worked out by hand."""

import pytest
from pyspark.sql import functions as F

from phenoframe.operators import align, audit, augment, evaluate, scaling
from phenoframe.operators.composite import decadal_composite, dense_series, long_to_series, series_to_long
from phenoframe.operators.gapfill import fill_gaps, irregular_to_grid
from phenoframe.operators.labels import dense_codes
from phenoframe.operators.terrain import slope_aspect


def test_composite_skips_nan_and_marks_empty_bins(spark):
    rows = [(1, "2021-01-02", float("nan"), 5.0), (1, "2021-01-03", 1.0, None), (1, "2021-01-09", 3.0, None), (1, "2020-06-01", 9.0, 9.0)]
    obs = spark.createDataFrame(rows, "p int, d string, a double, b double").withColumn("d", F.to_date("d"))
    comp = decadal_composite(obs, ["p"], "d", ["a", "b"], year=2021)
    assert [tuple(r) for r in comp.collect()] == [(1, 2021, 0, 2.0, 5.0, True)]
    row = dense_series(comp, ["p"], ["a", "b"]).first()
    assert len(row["series"]) == 36 and row["series"][0] == [2, 5] and row["series"][1] == [0, 0]
    assert row["mask"] == [True] + [False] * 35


def test_tail_of_the_year(spark):
    obs = spark.createDataFrame([(1, "2021-12-31", 1.0)], "p int, d string, a double").withColumn("d", F.to_date("d"))
    assert [r["bin"] for r in decadal_composite(obs, ["p"], "d", ["a"]).collect()] == [35]
    assert decadal_composite(obs, ["p"], "d", ["a"], tail="drop").count() == 0


@pytest.mark.parametrize(
    "edge, want", [("hold", [2, 2, 3, 4, 4]), ("leading_zero", [0, 2, 3, 4, 4]), ("fill", [0, 2, 3, 4, 0])]
)
def test_fill_gaps(spark, edge, want):
    rows = [(1, t, v) for t, v in enumerate([None, 2.0, None, 4.0, None])] + [(2, 0, None), (2, 1, None)]
    df = spark.createDataFrame(rows, "p int, t int, v double")
    out = fill_gaps(df, ["p"], "t", ["v"], edge=edge).orderBy("p", "t").collect()
    assert [r["v"] for r in out] == want + [0, 0]


def test_irregular_to_grid(spark):
    rows = [(1, 5.0, 10.0), (1, 15.0, 20.0), (1, 30.0, 50.0), (2, 12.0, 7.0)]
    df = spark.createDataFrame(rows, "p int, t double, v double")
    out = irregular_to_grid(df, ["p"], "t", "v", start=0.0, step=10.0, n_steps=5, fill=-1.0)
    got = {(r["p"], r["t"]): round(r["v"], 6) for r in out.collect()}
    assert [got[(1, i)] for i in range(5)] == [-1, 15, 30, 50, -1]
    assert [got[(2, i)] for i in range(5)] == [-1] * 5


def test_series_round_trip(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, None]], [True, False])], "p int, series array<array<double>>, mask array<boolean>")
    back = long_to_series(series_to_long(df, ["p"], ["a", "b"]), ["p"], ["a", "b"])
    assert back.first() == df.first()


def test_merge_chunks(spark):
    a = spark.createDataFrame([("x", 1, 0.5, 1), ("y", None, 0.7, 1)], "`system:index` string, crop_label int, B2_t0 double, m_t0 int")
    b = spark.createDataFrame([("x", 2.5, 1.5, 1), ("z", 9.0, 2.5, 1)], "`system:index` string, lon double, B2_t1 double, m_t1 int")
    out = align.merge_chunks([a, b], "system:index", ["crop_label", "lon"])
    got = {r["system:index"]: r for r in out.collect()}
    assert (got["x"]["B2_t0"], got["x"]["B2_t1"], got["x"]["m_t1"], got["x"]["lon"]) == (0.5, 1.5, 1, None)
    assert (got["z"]["B2_t0"], got["z"]["m_t0"], got["z"]["lon"]) == (None, 0, 9.0)
    assert {r["system:index"] for r in align.merge_chunks([a, b], "system:index", ["crop_label"], "crop_label").collect()} == {"x"}


def test_dense_codes(spark):
    df = spark.createDataFrame([(5,), (1,), (0,), (5,), (176,), (-1,)], "code int")
    assert {r["code"]: r["class_id"] for r in dense_codes(df, "code").collect()} == {1: 0, 5: 1, 176: 2}


def test_class_weights_and_boost(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    plain = {r["y"]: r["weight"] for r in scaling.class_weights(df, "y", split=None).collect()}
    lifted = {r["y"]: r["weight"] for r in scaling.class_weights(df, "y", split=None, boost=1.3).collect()}
    assert plain == {0: pytest.approx(0.666667, abs=1e-6), 1: 2.0}
    assert lifted == {0: pytest.approx(0.666667, abs=1e-6), 1: pytest.approx(2.6)}
    weights = scaling.sample_weights(df, "y", scaling.class_weights(df, "y", split=None))
    assert weights.agg(F.avg("sample_weight")).first()[0] == pytest.approx(1.0)


def test_scaler_handles_constant_channels(spark):
    df = spark.createDataFrame(
        [([[1.0, 5.0], [3.0, 5.0]], "train"), ([[5.0, 6.0], [0.0, 5.0]], "test")], "series array<array<double>>, split string"
    )
    fitted = scaling.fit_series_scaler(df, ["a", "b"])
    assert {r["name"]: (r["mean"], r["std"]) for r in fitted.collect()} == {"a": (2, 1), "b": (5, 0)}
    rows = scaling.apply_series_scaler(df, fitted).orderBy("split").collect()
    assert rows[0]["series"] == [[3, 1], [-2, 0]]


def test_impute(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (float("nan"), "train"), (None, "test"), (99.0, "test")], "v double, split string")
    assert sorted(r["v"] for r in scaling.impute_median(df, ["v"]).collect()) == [1, 2, 2, 3, 99]
    assert sorted(r["v"] for r in scaling.impute_zero(df, ["v"]).collect()) == [0, 0, 1, 3, 99]


def test_median_of_whole_numbers_is_not_cut(spark):
    df = spark.createDataFrame([(2, "train"), (3, "train"), (None, "test")], "v int, split string")
    assert sorted(r["v"] for r in scaling.impute_median(df, ["v"]).collect()) == [2, 2.5, 3]


def test_rows_without_class_keep_a_null_weight(spark):
    df = spark.createDataFrame([(0, "train"), (0, "train"), (1, "train"), (None, "train")], "y int, split string")
    rows = scaling.sample_weights(df, "y", scaling.class_weights(df, "y")).collect()
    assert len(rows) == 4 and [r["sample_weight"] for r in rows if r["y"] is None] == [None]


def test_classes_outside_the_range_count_as_wrong(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 7), (0, None)], "y int, p int")
    cm = evaluate.confusion_matrix(df, "y", "p", 2)
    assert cm.count() == 6 and cm.agg(F.sum("n")).first()[0] == 4
    assert evaluate.accuracy_kappa(cm).first()["accuracy"] == 0.5


def test_null_strata_and_classes_are_counted(spark):
    df = spark.createDataFrame([("a", 0), ("a", None), (None, 0), (None, 0)], "z string, y int")
    rows = {(r["z"], r["y"]): (r["n"], r["percent"]) for r in audit.class_distribution(df, "y", ["z"]).collect()}
    assert rows == {("a", 0): (1, 50.0), ("a", None): (1, 50.0), (None, 0): (2, 100.0)}


@pytest.mark.parametrize("hot", [None, 1])
def test_rows_without_date_enter_no_composite(spark, hot):
    df = spark.createDataFrame([(1, "2021-01-01", 1.0), (1, "2021-01-02", 3.0), (1, None, 9.0)], "p int, d string, a double")
    rows = decadal_composite(df.withColumn("d", F.to_date("d")), ["p"], "d", ["a"], hot_rows=hot).collect()
    assert [(r["bin"], r["a"]) for r in rows] == [(0, 2.0)]


def test_nan_is_a_gap(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([nan, 2.0, nan, 4.0])], "p int, t int, v double")
    assert [r["v"] for r in fill_gaps(df, ["p"], "t", ["v"]).orderBy("t").collect()] == [2, 2, 3, 4]


def test_perfect_agreement(spark):
    df = spark.createDataFrame([(0, 0)] * 3 + [(1, 1)] * 2, "y int, p int")
    row = evaluate.evaluation(df, "y", "p", 3).first()
    assert tuple(row) == (1.0, 1.0, 1.0, 1.0)
    cm = evaluate.confusion_matrix(df, "y", "p", 3)
    assert cm.count() == 9 and {r["share"] for r in cm.where("y_true = 2").collect()} == {0.0}


def test_best_epoch_takes_the_first_minimum(spark):
    rows = [("a", e, loss, 0.1 * e) for e, loss in enumerate([3.0, 2.0, 2.5, 2.0], 1)]
    df = spark.createDataFrame(rows, "config string, epoch int, val_loss double, val_accuracy double")
    best = evaluate.best_epochs(df).first()
    assert (best["best_epoch"], best["best_val_loss"]) == (2, 2.0)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "v double")
    assert {r["bucket"]: r["n"] for r in audit.histogram(df, "v").collect()} == {1: 1, 30: 1}


def test_coerce_and_unknown_ids(spark):
    df = spark.createDataFrame([("3",), ("4.0",), ("x",), (None,)], "id string")
    ids = align.coerce_id(df, "id")
    assert sorted(r["id"] for r in ids.collect()) == [3, 4]
    known = spark.createDataFrame([(3,)], "id long")
    assert [r["id"] for r in align.unknown_ids(ids, known, "id").collect()] == [4]


def test_plane_has_one_slope(spark):
    rows = [(r, c, 10.0 * c) for r in range(4) for c in range(4)]
    dem = spark.createDataFrame(rows, "row long, col long, elevation double")
    out = {(r["row"], r["col"]): (r["slope"], r["aspect"]) for r in slope_aspect(dem, dx=10.0, dy=10.0).collect()}
    assert out[(1, 1)] == (pytest.approx(45.0), pytest.approx(270.0))  # rises east, faces west
    assert out[(0, 0)] == (None, None) and len(out) == 16


def test_augmentation_is_reproducible(spark):
    rows = [(i, [[1.0, 1.0]] * 20, [True] * 20) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, series array<array<double>>, mask array<boolean>")
    once = augment.drop_steps_and_jitter(df, ["id"], 20, sd=0.0).orderBy("id").collect()
    again = augment.drop_steps_and_jitter(df.repartition(7), ["id"], 20, sd=0.0).orderBy("id").collect()
    assert once == again
    zeros = [sum(s == [0, 0] for s in r["series"]) for r in once]
    assert set(zeros) <= {0, 2, 3, 4} and 30 < sum(z > 0 for z in zeros) < 90
    thinned = augment.mask_steps_and_jitter(df, ["id"], rate=0.2, sd=0.02).collect()
    kept = sum(sum(r["mask"]) for r in thinned)
    assert 0.75 < kept / 4000 < 0.85
    assert all((s == [0, 0]) == (not m) for r in thinned for s, m in zip(r["series"], r["mask"]))


def test_report(spark):
    df = spark.createDataFrame([(0, 7), (0, 7), (1, 3)], "y int, code int")
    row = audit.summary_report(df, "y", "code").first()
    assert (row["n_rows"], row["n_codes"], row["class_counts"]) == (3, 2, {"0": 2, "1": 1})
    assert row["top_codes"][0]["code"] == "7"
