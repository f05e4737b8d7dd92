"""The streaming composite over files that arrive one after another."""

from pathlib import Path

from pyspark.sql import functions as F

from phenoframe.operators.composite import decadal_composite
from phenoframe.streaming.composite import late_bins, run_available, stream_composite

SCHEMA = "p int, d date, a double"


def arrive(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "p int, d string, a double").select("p", F.to_date("d").alias("d"), "a")
    df.coalesce(1).write.mode("append").parquet(str(folder / name))


def test_closed_bins_equal_the_batch_result(spark, tmp_path):
    first = [(1, "2021-12-02", 4.0), (1, "2021-12-05", 2.0), (2, "2021-12-25", 8.0), (1, "2021-12-31", 6.0)]
    second = [(1, "2022-01-04", 1.0), (1, "2022-01-05", 3.0), (2, "2022-01-25", 5.0), (1, "2021-12-03", 99.0)]
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")

    def step():
        stream = spark.readStream.schema(SCHEMA).parquet(str(source / "*"))
        query = run_available(stream_composite(stream, ["p"], "d", ["a"]), out, progress)
        query.awaitTermination()
        rows = spark.read.parquet(out).select("p", "year", "bin", "a", "valid")
        return {tuple(r) for r in rows.collect()}

    arrive(spark, source, "one", first)
    assert step() == {(1, 2021, 33, 3.0, True)}
    arrive(spark, source, "two", second)
    closed = step()
    # The late value of the closed bin is dropped; the last bin of the year took Dec 31.
    assert closed == {
        (1, 2021, 33, 3.0, True), (2, 2021, 35, 8.0, True), (1, 2021, 35, 6.0, True), (1, 2022, 0, 2.0, True)
    }
    seen = spark.createDataFrame(first + second[:3], "p int, d string, a double").withColumn("d", F.to_date("d"))
    batch = decadal_composite(seen, ["p"], "d", ["a"])
    assert closed < {tuple(r) for r in batch.select("p", "year", "bin", "a", "valid").collect()}


def test_late_rows_inside_the_grace_count(spark, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")

    def step(name, rows):
        arrive(spark, source, name, rows)
        stream = spark.readStream.schema(SCHEMA).parquet(str(source / "*"))
        run_available(stream_composite(stream, ["p"], "d", ["a"], lateness="10 days"), out, progress).awaitTermination()
        return {(r["bin"], r["a"]) for r in spark.read.parquet(out).collect()}

    assert step("one", [(1, "2021-01-09", 1.0), (1, "2021-01-11", 5.0)]) == set()
    assert step("two", [(1, "2021-01-10", 3.0)]) == set()
    assert step("three", [(1, "2021-01-21", 7.0)]) == {(0, 2.0)}


def test_state_grows_with_different_values_only(spark, tmp_path):
    source = tmp_path / "in"
    arrive(spark, source, "one", [(1, "2021-06-01", float(i % 5)) for i in range(10_000)])
    stream = spark.readStream.schema(SCHEMA).parquet(str(source / "*"))
    query = run_available(stream_composite(stream, ["p"], "d", ["a"]), str(tmp_path / "out"), str(tmp_path / "progress"))
    query.awaitTermination()
    # five values and the count of rows, in the one open bin
    assert sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]) == 6


def test_state_does_not_grow_with_the_bands(spark, tmp_path):
    bands = ["a", "b", "c", "e"]
    rows = [(i % 3, "2021-06-01", *[float(i + k) if i < 30 else None for k in range(4)]) for i in range(33)] * 2
    schema = "p int, d date, a double, b double, c double, e double"
    df = spark.createDataFrame(rows, schema.replace("d date", "d string")).withColumn("d", F.to_date("d"))
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")

    def step(part, name):
        part.coalesce(1).write.parquet(str(source / name))
        stream = spark.readStream.schema(schema).parquet(str(source / "*"))
        query = run_available(stream_composite(stream, ["p"], "d", bands), out, progress)
        query.awaitTermination()
        return query

    # thirty different observations and three counts of rows; one entry per value would be 123
    assert sum(op["numRowsTotal"] for op in step(df, "one").lastProgress["stateOperators"]) == 33
    step(df.withColumn("d", F.to_date(F.lit("2021-07-20"))), "two")
    got = spark.read.parquet(out)
    want = decadal_composite(df, ["p"], "d", bands).select("p", "year", "bin", *bands, "valid")
    assert got.count() == 3 and {r["observations"] for r in got.collect()} == {22}
    assert {tuple(r) for r in got.select(*want.columns).collect()} == {tuple(r) for r in want.collect()}


def test_state_lies_on_disk(spark, tmp_path):
    source, provider = tmp_path / "in", "spark.sql.streaming.stateStore.providerClass"
    arrive(spark, source, "one", [(1, "2021-06-01", float(i)) for i in range(300)])

    def step(name):
        stream = spark.readStream.schema(SCHEMA).parquet(str(source / "*"))
        query = run_available(stream_composite(stream, ["p"], "d", ["a"]), str(tmp_path / name / "out"), str(tmp_path / name / "progress"))
        query.awaitTermination()
        return [op["customMetrics"].get("rocksdbPutCount") for p in query.recentProgress for op in p["stateOperators"]]

    assert sum(step("disk")) == 301  # no value is missing: every store is one on disk
    assert spark.conf.get(provider, None) is None  # the session is left as it was
    arrive(spark, source, "two", [(1, "2021-07-20", 1.0)])
    assert sum(step("disk")) >= 2  # a later start finds what is on disk
    made = [(r["bin"], r["a"], r["observations"]) for r in spark.read.parquet(str(tmp_path / "disk" / "out")).collect()]
    assert made == [(15, 149.5, 300)]
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:  # a store that the session names is kept
        assert set(step("other")) == {None}
        assert "HDFSBacked" in spark.conf.get(provider)
    finally:
        spark.conf.unset(provider)


def test_stores_set_no_disk_aside(spark, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    for name in ("one", "two"):
        arrive(spark, source, name, [(1, "2021-06-01", 1.0)])
        stream = spark.readStream.schema(SCHEMA).parquet(str(source / "*"))
        run_available(stream_composite(stream, ["p"], "d", ["a"]), out, progress).awaitTermination()
    local = Path(spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf()))
    taken = [f.stat().st_blocks * 512 for f in local.glob("**/StateStoreId*/**/MANIFEST-*")]
    assert taken and max(taken) < 1_000_000


def test_late_rows_are_reported_by_bin(spark, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    arrivals = [
        [(1, "2021-01-02", 1.0), (1, "2021-01-02", 1.0), (None, "2021-01-03", 2.0), (1, "2021-03-20", 5.0), (3, None, 1.0)],
        # two rows of a final bin, one of a bin that never had any, one of a null key, one in time, one not read as a value
        [(1, "2021-01-04", 9.0), (1, "2021-01-05", float("nan")), (2, "2021-01-12", 4.0), (None, "2021-01-03", 7.0), (1, "2021-03-12", 6.0)],
    ]
    for name, rows in enumerate(arrivals):
        arrive(spark, source, str(name), rows)
        stream = spark.readStream.schema(SCHEMA).parquet(str(source / "*"))
        run_available(stream_composite(stream, ["p"], "d", ["a"]), out, progress).awaitTermination()
    made = spark.read.parquet(out)
    assert {(r["p"], r["bin"], r["a"], r["observations"]) for r in made.collect()} == {(1, 0, 1.0, 2), (None, 0, 2.0, 1)}
    late = late_bins(spark.read.schema(SCHEMA).parquet(str(source / "*")), made, ["p"], "d")
    assert {(r["p"], r["year"], r["bin"], r["n_late"]) for r in late.collect()} == {(1, 2021, 0, 2), (2, 2021, 1, 1), (None, 2021, 0, 1)}
    none = spark.read.schema(SCHEMA).parquet(str(source / "*")).where("false")
    assert late_bins(none, made.where("false"), ["p"], "d").collect() == []
