"""Ranks, segments, medians and draws against brute force, whatever the partitioning."""

import hashlib
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from phenoframe.operators import composite, correlate, sampling
from phenoframe.operators.composite import decadal_composite
from phenoframe.operators.correlate import spearman_matrix
from phenoframe.scale import medians, ranks
from phenoframe.scale.bounds import heavy_keys, materialised, scratch, shared_folder, small_table


def skewed(n=4000):
    """A class column in which one class holds most rows."""
    return [(i, 0 if i % 10 < 7 else i % 4) for i in range(n)]


def order(i):
    return (hashlib.md5(f"42-{i}".encode()).hexdigest(), i)


def brute_ranks(rows):
    groups = {}
    for i, y in rows:
        groups.setdefault(y, []).append(i)
    return {
        i: (y, place, len(ids))
        for y, ids in groups.items()
        for place, i in enumerate(sorted(ids, key=order), 1)
    }


@pytest.mark.parametrize("partitions", [1, 13])
@pytest.mark.parametrize("digits", [1, 3])
def test_hash_rank(spark, partitions, digits):
    rows = skewed()
    df = spark.createDataFrame(rows, "id long, y int").repartition(partitions)
    got = {r["id"]: r["rank"] for r in ranks.hash_rank(df, ["y"], ["id"], digits=digits).collect()}
    assert got == {i: place for i, (_, place, _) in brute_ranks(rows).items()}


@pytest.mark.parametrize("digits", [1, 2, 3])
@pytest.mark.parametrize("cuts", [(240, 300), (0, 5), (10**9, 10**9), (1, 1)])
def test_hash_segments(spark, digits, cuts):
    rows = skewed()
    df = spark.createDataFrame(rows, "id long, y int").repartition(5)
    columns = [F.least(F.lit(c), F.col("n")) for c in cuts]
    out = ranks.hash_segments(df, ["y"], ["id"], columns, digits=digits)
    got = {r["id"]: r["segment"] for r in out.collect()}
    want = {i: sum(place > min(c, n) for c in cuts) for i, (_, place, n) in brute_ranks(rows).items()}
    assert got == want


def test_segments_do_not_shuffle_the_data(spark):
    df = spark.createDataFrame(skewed(), "id long, y int")
    out = ranks.hash_segments(df, ["y"], ["id"], [F.lit(100)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_paper_split_small_class(spark):
    df = spark.range(250).select("id", F.lit(1).alias("y"))
    counts = {r["split"]: r["count"] for r in sampling.paper_split(df, "y", ["id"]).groupBy("split").count().collect()}
    assert counts == {"train": 240, "val": 10}


def test_sequential_id(spark):
    rows = [(i % 7, i) for i in range(500)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, v int").repartition(9)
    got = [(r["id"], r["k"], r["v"]) for r in ranks.sequential_id(df, ["k", "v"]).orderBy("id").collect()]
    assert got == [(n, k, v) for n, (k, v) in enumerate(sorted(rows))]


@pytest.mark.parametrize("slices", [1, 4, 256])
def test_split_medians(spark, slices):
    random.seed(3)
    rows = [("a", random.choice([None, random.gauss(0, 1), 5.0]), float(i % 3)) for i in range(999)]
    rows += [("b", None, 1.0), ("b", None, 2.0), ("c", 4.0, None)]
    df = spark.createDataFrame(rows, "g string, u double, v double").repartition(6)
    got = {r["g"]: (r["u"], r["v"]) for r in medians.split_medians(df, ["g"], ["u", "v"], slices).collect()}

    def want(g, k):
        known = [r[k] for r in rows if r[0] == g and r[k] is not None]
        return statistics.median(known) if known else None

    assert got == {g: (want(g, 1), want(g, 2)) for g in "abc"}


def test_column_medians_take_the_wide_path(spark):
    df = spark.createDataFrame([(float(i * i), float(-i)) for i in range(100)], "a double, b double")
    small = medians.column_medians(df, ["a", "b"]).first()
    wide = medians.column_medians(df, ["a", "b"], max_distinct=3).first()
    assert tuple(small) == tuple(wide)


def test_hot_keys_give_the_same_composites(spark):
    random.seed(5)
    rows = [
        (0 if random.random() < 0.6 else random.randrange(5), f"2021-{random.randrange(1, 13):02d}-15",
         random.choice([None, float("nan"), random.random()]), random.random())
        for _ in range(1500)
    ]
    df = spark.createDataFrame(rows, "p int, d string, a double, b double").withColumn("d", F.to_date("d"))
    args = (df, ["p"], "d", ["a", "b"])
    plain = decadal_composite(*args, hot_rows=None)
    split = decadal_composite(*args, hot_rows=400)
    assert [r["p"] for r in heavy_keys(df, ["p"], 400).collect()] == [0]

    def rounded(frame):
        return sorted(
            (r["p"], r["bin"], r["a"] and round(r["a"], 9), round(r["b"], 9), r["valid"]) for r in frame.collect()
        )

    assert rounded(plain) == rounded(split)


def test_average_ranks_with_ties(spark):
    rows = [(1.0, 4.0), (1.0, 1.0), (2.0, 3.0), (3.0, 3.0), (5.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    corr = {(r["a"], r["b"]): r["corr"] for r in spearman_matrix(df, ["a", "b"]).collect()}
    assert corr[("a", "b")] == pytest.approx(-0.157895, abs=1e-6)
    assert corr[("a", "a")] == pytest.approx(1.0)


def test_average_ranks_slices(spark):
    random.seed(9)
    values = [random.choice([1.0, 2.5, random.random() * 100]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["value"]: r["rank"] for r in ranks.average_ranks(df, ["v"], slices=16).collect()}
    ordered = sorted(values)
    first = {}
    for place, v in enumerate(ordered, 1):
        first.setdefault(v, []).append(place)
    assert got == {v: sum(p) / len(p) for v, p in first.items()}


@pytest.mark.parametrize("per_task", [3, 100_000])
def test_oversampling_is_salted_but_unchanged(spark, per_task):
    rows = [(i, 0) for i in range(300)] + [(1000 + i, 1) for i in range(2)] + [(2000, 2)]
    df = spark.createDataFrame(rows, "id long, y int")
    out = sampling.oversample_balanced(df, "y", ["id"], per_task=per_task).collect()
    want = brute_ranks(rows)
    by_rank = {(y, place): i for i, (y, place, _) in want.items()}
    sizes = {0: 300, 1: 2, 2: 1}
    expected = set()
    for y, n in sizes.items():
        for slot in range(300):
            word = int(hashlib.md5(f"42-{y}-{slot}".encode()).hexdigest()[:15], 16)
            expected.add((by_rank[(y, word % n + 1)], y, slot))
    assert len(out) == 900
    assert {(r["id"], r["y"], r["slot"]) for r in out} == expected


def test_same_sample_on_any_partitioning(spark):
    base = spark.range(5000).select("id", (F.col("id") % 3).cast("int").alias("y"))
    picks = [
        {r["id"] for r in sampling.equal_sample(base.repartition(n), "y", ["id"], 300).collect()} for n in (1, 11)
    ]
    assert picks[0] == picks[1] and len(picks[0]) == 300


def test_small_table_keeps_large_results_distributed(spark):
    df = spark.range(50)
    assert small_table(df, 10) is df
    assert "LocalTableScan" in small_table(df, 100)._jdf.queryExecution().executedPlan().toString()


def test_materialised_reads_back_a_table(spark):
    df = materialised(spark.range(10).withColumn("x", F.array(F.lit(1.0))))
    assert df.count() == 10 and "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("split", ["paper", "ratio"])
def test_rows_without_class_get_a_split(spark, split):
    df = spark.createDataFrame([(i, i % 3 if i % 4 else None) for i in range(100)], "id int, y int")
    made = sampling.paper_split(df, "y", ["id"], 10, 5) if split == "paper" else sampling.ratio_split(df, ["y"], ["id"])
    rows = made.collect()
    assert len(rows) == 100 and all(r["split"] for r in rows)
    assert sum(r["y"] is None for r in rows) == 25
    assert len({r["split"] for r in rows if r["y"] is None}) == 3


def test_draws_use_sixty_bits(spark):
    digest = hashlib.md5(b"42-1-0").hexdigest()
    got = spark.range(1).select(ranks.hash_long(ranks.stable_hash(42, F.lit(1), F.lit(0)))).first()[0]
    assert got == int(digest[:15], 16)


def test_rank_correlation_with_missing_values(spark):
    nan = float("nan")
    rows = [(1.0, 2.0), (2.0, 1.0), (nan, 5.0), (3.0, None), (4.0, 4.0), (5.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {(r["a"], r["b"]): r["corr"] for r in spearman_matrix(df, ["a", "b"]).collect()}
    # ranks of the four complete rows: a 1 2 3 4, b 2 1 4 3
    assert got["a", "b"] == pytest.approx(0.6) == got["b", "a"] and got["a", "a"] == pytest.approx(1)
    assert len(got) == 4


def test_sampled_points_are_written_once(spark):
    obs = spark.range(1000).select((F.col("id") % 100).alias("p"), "id")
    got = sampling.read_sampled(obs, spark.range(50).select(F.col("id").alias("p")), ["p"])
    assert got.count() == 500
    assert "hashpartitioning(p" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_scratch_folder_is_deleted(spark):
    with scratch(spark, "tmp") as folder:
        assert materialised(spark.range(3), folder).count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(folder)
    with pytest.raises(ZeroDivisionError):
        with scratch(spark, "tmp") as folder:
            materialised(spark.range(3), folder)
            1 / 0
    with pytest.raises(Exception):
        spark.read.parquet(folder)


def test_row_ranks_share_ties_across_partitions(spark):
    rng = random.Random(9)
    rows = [(i, 5.0 if i % 3 == 0 else float(rng.randrange(400)), rng.random(), 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    got = {(r["k"], r["name"]): r["rank"] for r in ranks.row_ranks(df, "k", ["a", "b", "c"]).collect()}
    for at, name in enumerate("abc", 1):
        places = {}
        for n, (v, _) in enumerate(sorted((r[at], r[0]) for r in rows), 1):
            places.setdefault(v, []).append(n)
        for r in rows:
            assert got[r[0], name] == pytest.approx(sum(places[r[at]]) / len(places[r[at]]))
    assert len(got) == 9000


def test_spearman_never_joins_on_a_value(spark, monkeypatch):
    monkeypatch.setattr(correlate, "FEW_VALUES", 20)
    rng = random.Random(2)
    rows = [(float(rng.randrange(5)), rng.choice([0.0, rng.random()]), rng.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["a"], r["b"]): r["corr"] for r in correlate.spearman_matrix(df, ["a", "b", "c"]).collect()}
    want = pd.DataFrame(rows, columns=["a", "b", "c"]).corr("spearman")
    assert all(got[i, j] == pytest.approx(want.loc[i, j]) for i in "abc" for j in "abc")
    plan = correlate._ranked_matrix(df, ["b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(b" not in plan and "hashpartitioning(c" not in plan


def test_rows_at_ranks_equal_the_full_ranking(spark):
    df = spark.range(4000).select(F.col("id"), (F.col("id") % 3).alias("y"))
    full = {(r["y"], r["rank"]): r["id"] for r in ranks.hash_rank(df, ["y"], ["id"], 7, "rank").collect()}
    wanted = [(y, r, n) for n, (y, r) in enumerate([(0, 1), (0, 1334), (1, 700), (1, 700), (2, 1333), (2, 5), (2, 9999)])]
    picks = spark.createDataFrame(wanted, "y bigint, rank bigint, slot int")
    for digits in (1, 2, 3):
        got = sorted((r["slot"], r["id"]) for r in ranks.rows_at_ranks(df, "y", ["id"], picks, 7, digits).collect())
        assert got == [(n, full[y, r]) for y, r, n in wanted if (y, r) in full]


def test_only_finite_radar_and_climate_values_count(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "2021-01-05", 2.0, 4.0), (1, "2021-01-06", nan, 6.0), (1, "2021-02-01", inf, nan), (2, "2021-01-01", 1.0, 1.0)]
    obs = spark.createDataFrame(rows, "id int, d string, vv double, vh double").withColumn("d", F.col("d").cast("date"))
    got = {r["id"]: r for r in composite.monthly_radar(obs, "id", "d").collect()}
    assert (got[1]["vv_01"], got[1]["vh_01"], got[1]["vv_02"], got[1]["vh_02"]) == (2.0, 5.0, 0.0, 0.0)
    found = composite.climate_aggregate(obs, "id", "d", "2021-01-01", "2022-01-01", "vv", "vh", "vv").collect()
    assert {r["id"]: tuple(r)[1:] for r in found} == {1: (2.0, 5.0, 2.0), 2: (1.0, 1.0, 1.0)}
