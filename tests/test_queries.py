"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from phenoframe.registry import ORACLES, QUERIES
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_registry_is_consistent():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert set(QUERIES) - set(ORACLES) == {
        "multimodal_preparation", "feature_importance", "feature_ablation", "learning_rates"
    }


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["y", "t", "mean", "std", "n"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare(queries()[name](spark, SF), duck, oracle_sql()[name]) == ""


def test_importance_sums_to_one(spark):
    rows = queries()["feature_importance"](spark, SF).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)


def test_modalities_are_standardised_on_training_rows(spark):
    rows = queries()["multimodal_preparation"](spark, SF).where("split = 'train'")
    row = rows.selectExpr("avg(elevation) a", "stddev_pop(elevation) s", "avg(vv_01) m").first()
    assert (row["a"], row["s"], row["m"]) == (pytest.approx(0, abs=1e-9), pytest.approx(1), pytest.approx(0, abs=1e-9))


def test_ablation_has_one_row_per_feature_set(spark):
    rows = queries()["feature_ablation"](spark, SF).collect()
    assert [r["config"] for r in rows] == ["optical", "optical_static", "optical_radar", "optical_radar_static"]
    assert all(0 <= r["accuracy"] <= r["top2"] <= 1 and r["loss"] > 0 for r in rows)
