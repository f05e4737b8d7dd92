"""Readers and writers on files of their own."""

import json

import pytest
from pyspark.sql import functions as F

from phenoframe.operators.audit import summary_report
from phenoframe.schemas import BANDS, CHUNK_STEPS, N_STEPS
from phenoframe.sources import chunks, scenes, sinks, tables


def write_chunk(folder, name, first, last, rows, extra=()):
    """A chunk CSV with alphabetical columns, as exporters write them."""
    columns = ["system:index", *extra] + [f"{b}_t{t}" for b in BANDS for t in range(first, last + 1)]
    columns = sorted(columns + [f"m_t{t}" for t in range(first, last + 1)])
    lines = [",".join(columns)]
    for index, values in rows.items():
        cells = {"system:index": index, **values}
        lines.append(",".join(str(cells.get(c, "1" if c.startswith("m_t") else f"{len(c)}.5")) for c in columns))
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.fixture()
def chunk_folder(tmp_path):
    for k, (first, last) in enumerate(CHUNK_STEPS):
        rows = {f"{i}_0": {"crop_label": i % 6, "lon": -121.0 - i, "lat": 38.0} for i in range(4)}
        if k == 2:
            rows.pop("3_0")
        write_chunk(tmp_path, f"chunk{k}_t.csv", first, last, rows, ("crop_label", "lon", "lat"))
    return tmp_path


def test_chunks_merge_and_fold(spark, chunk_folder):
    merged = chunks.load_samples(spark, str(chunk_folder / "chunk*_t*.csv"))
    chunks.validate_schema(merged.columns)
    folded = chunks.fold_series(merged)
    rows = {r["system:index"]: r for r in folded.collect()}
    assert set(rows) == {f"{i}_0" for i in range(4)}
    assert len(rows["0_0"]["series"]) == N_STEPS and len(rows["0_0"]["series"][0]) == len(BANDS)
    assert rows["0_0"]["series"][0][BANDS.index("B8A")] == 6.5  # len("B8A_t0") + .5, found by name
    assert rows["3_0"]["mask"][18:27] == [False] * 9 and rows["3_0"]["mask"][0]
    assert rows["3_0"]["series"][20][0] is None


def test_missing_files_and_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        chunks.read_chunks(spark, str(tmp_path / "nothing*.csv"))
    with pytest.raises(ValueError, match="crop_label"):
        chunks.validate_schema(["B2_t0"])
    with pytest.raises(ValueError, match="missing"):
        chunks.validate_schema(["crop_label", "B2_t0", "m_t0"])
    with pytest.raises(KeyError):
        chunks.label_column(["lon"])
    assert chunks.coordinate_columns(["lon", "lat", "longitude", "latitude"]) == ("longitude", "latitude")
    assert chunks.infer_columns(["B11_t10", "B8A_t2", "B11_t9", "m_t10", "m_t2", "x_t1"]) == (
        ["B11_t9", "B11_t10", "B8A_t2"], ["m_t2", "m_t10"]
    )


def test_absent_series_columns_become_zero(spark):
    df = spark.createDataFrame([("a", 4.0)], "`system:index` string, B2_t0 double")
    row = chunks.fold_series(df, ["B2", "B3"], 2).first()
    assert row["series"] == [[4, 0], [0, 0]] and row["mask"] == [False, False]


def test_points_file_or_chunks(spark, chunk_folder):
    (chunk_folder / "points.csv").write_text("id,lon,lat\n7,-120.0,38.0\n8,,38.0\n")
    glob = str(chunk_folder / "chunk*.csv")
    listed = tables.read_points(spark, str(chunk_folder / "points.csv"), glob)
    assert [tuple(r) for r in listed.collect()] == [(7, -120.0, 38.0)]
    derived = tables.read_points(spark, str(chunk_folder / "absent.csv"), glob).orderBy("id")
    assert [(r["id"], r["lon"]) for r in derived.collect()] == [(i, -121.0 - i) for i in range(4)]


def test_scene_list_and_catalog(spark, tmp_path):
    names = ["S2B_MSIL2A_20250611T162901_N1.SAFE", "S2A_MSIL2A_20250601T162901_N0.SAFE"]
    (tmp_path / "safes.txt").write_text(f"# scenes\n\n /d/{names[0]} \n/d/{names[1]}\n")
    rows = scenes.read_scene_list(spark, str(tmp_path / "safes.txt")).collect()
    assert [str(r["acq_date"]) for r in rows] == ["2025-06-01", "2025-06-11"]
    for resolution, band in [("R20m", "B05"), ("R10m", "B02"), ("R20m", "B02"), ("R60m", "B01")]:
        folder = tmp_path / "S" / "GRANULE" / "L2A_T15" / "IMG_DATA" / resolution
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"T15_2025_{band}_{resolution[1:]}.jp2").write_bytes(b"x")
    files = scenes.list_band_files(spark, str(tmp_path / "S"))
    catalog = scenes.band_catalog(files)
    assert {(r["band"], r["resolution"]) for r in catalog.collect()} == {("B02", "R10m"), ("B05", "R20m")}
    assert [r["band"] for r in scenes.missing_bands(catalog, ["B02", "B08"]).collect()] == ["B08"]
    with pytest.raises(KeyError):
        scenes.require_bands(catalog, ["B08"])


def test_numeric_csv_mapping_and_rasters(spark, tmp_path):
    (tmp_path / "cov.csv").write_text("slope,id,clay\n1.5,3,\n,4,20\n")
    cov = tables.read_numeric_csv(spark, str(tmp_path / "cov.csv"))
    assert [tuple(r) for r in cov.orderBy("id").collect()] == [(1.5, "3", None), (None, "4", 20.0)]
    assert tables.static_columns(cov.columns) == ["slope", "clay"]
    (tmp_path / "map.json").write_text(json.dumps({"69": 0, "3": 1}))
    mapping = tables.read_mapping(spark, str(tmp_path / "map.json"))
    assert {tuple(r) for r in mapping.collect()} == {(69, 0), (3, 1)}
    spark.createDataFrame([(0, 1, -9999.0), (0, 2, 5.0)], "row int, col int, b2 double").write.parquet(str(tmp_path / "r"))
    raster = tables.read_raster_table(spark, str(tmp_path / "r"), ["b2"], -9999.0)
    assert {r["b2"] for r in raster.collect()} == {None, 5.0}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", 0), (2, "val", 1), (3, "test", 1)], "id int, split string, y int")
    sinks.write_splits(df, str(tmp_path / "data"))
    assert {r["id"] for r in sinks.read_splits(spark, str(tmp_path / "data")).collect()} == {1, 2, 3}
    pruned = sinks.read_splits(spark, str(tmp_path / "data"), ["train"])
    assert [r["id"] for r in pruned.collect()] == [1]
    assert "PartitionFilters: [isnotnull(split" in pruned._jdf.queryExecution().executedPlan().toString()
    sinks.write_scaler(df.limit(1), str(tmp_path / "scaler"))
    assert sinks.read_scaler(spark, str(tmp_path / "scaler")).count() == 1
    sinks.write_report(summary_report(df, "y", "y"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["n_rows"] == 3
    sinks.write_table(df, str(tmp_path / "table"), order=["id"])
    back = spark.read.csv(str(tmp_path / "table"), header=True)
    assert back.columns == ["id", "split", "y"] and back.count() == 3
    with pytest.raises(Exception):
        sinks.write_table(df, str(tmp_path / "table"))


def test_points_without_numeric_index_are_numbered(spark):
    df = spark.createDataFrame([("a_1", 1.0, 2.0), ("b_2", 3.0, 4.0), ("b_2", 3.0, 4.0), ("c", None, 1.0)], "`system:index` string, lon double, lat double")
    rows = tables.identified_points(df).orderBy("id").collect()
    assert [(r["id"], r["lon"]) for r in rows] == [(0, 1.0), (1, 3.0)]


def test_points_with_some_numbers_or_coordinates(spark):
    df = spark.createDataFrame([("5", None, 2.0), ("5", 1.0, 2.0), ("x", 3.0, 4.0), ("0", 7.0, 8.0)], "id string, lon double, lat double")
    rows = tables.identified_points(df).collect()
    assert {(r["id"], r["lon"]) for r in rows if r["lon"] != 3.0} == {(5, 1.0), (0, 7.0)}
    assert [r["id"] for r in rows if r["lon"] == 3.0][0] > 5
    plain = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "lon double, lat double")
    assert [r["id"] for r in tables.identified_points(plain).orderBy("id").collect()] == [0, 1]


def test_scaler_state_round_trip(spark, tmp_path):
    from phenoframe.operators import scaling

    df = spark.createDataFrame([([[1.0], [3.0]],)], "series array<array<double>>")
    sinks.write_scaler(scaling.fit_series_scaler(df, ["a"], split=None), str(tmp_path / "s"))
    again = scaling.apply_series_scaler(df, sinks.read_scaler(spark, str(tmp_path / "s")))
    assert again.first()["series"] == [[-1], [1]]
    assert df.select(F.flatten("series")).first()[0] == [1, 3]


def test_versions_are_seen_only_when_committed(spark, tmp_path):
    path = str(tmp_path / "set")
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, path)
    first = spark.createDataFrame([(1, "001", None), (2, "002", 2.5)], "id int, split string, x double")
    assert sinks.write_version(first, path, partition_by=["split"]) == 1
    first.write.parquet(f"{path}/data/half")  # never committed
    assert sinks.write_version(first.where("id = 2").drop("x"), path, "json") == 2
    assert [tuple(r) for r in sinks.read_version(spark, path).collect()] == [(2, "002")]
    old = sinks.read_version(spark, path, 1)
    assert sorted(map(tuple, old.select("id", "split", "x").collect())) == [(1, "001", None), (2, "002", 2.5)]
    assert {(r["version"], r["n_rows"]) for r in sinks.committed(spark, path).collect()} == {(1, 2), (2, 1)}
    assert sinks.write_version(first.where("false"), path) == 3 and sinks.read_version(spark, path).collect() == []


def test_first_rows_of_repeated_keys(spark, tmp_path):
    (tmp_path / "a1.csv").write_text("system:index,crop_label,B2_t0,m_t0,temp_t\nk,,1.5,1,9\nk,4,2.5,0,9\nl,2,,1,9\n")
    (tmp_path / "a2.csv").write_text("system:index,crop_label,B2_t0,m_t0,temp_t\nl,3,7.5,0,9\nm,5,8.5,,9\n")
    (tmp_path / "b.csv").write_text("system:index,crop_label,B2_t1\nm,1,0.5\nm,2,0.25\nn,6,3.0\n")
    got = {r["system:index"]: r for r in chunks.load_samples(spark, str(tmp_path / "*.csv")).collect()}
    assert set(got) == {"l", "m", "n"}  # the first row of k has no label
    assert "temp_t" not in got["l"].asDict()
    assert tuple(got["l"][c] for c in ("crop_label", "B2_t0", "m_t0", "B2_t1")) == (2, None, 1, None)
    assert tuple(got["m"][c] for c in ("crop_label", "B2_t0", "m_t0", "B2_t1")) == (5, 8.5, 0, 0.5)
    assert tuple(got["n"][c] for c in ("crop_label", "B2_t0", "m_t0", "B2_t1")) == (6, None, 0, 3.0)


def test_headers_take_one_job_for_any_number_of_files(spark, tmp_path):
    for i in range(90):
        head = "system:index,B2_t0" if i % 3 else 'system:index,"B2_t1",note'
        (tmp_path / f"c{i:02d}.csv").write_text(f"{head}\r\nk{i},1,x\n" if i % 2 else f"{head}\n")
    (tmp_path / "empty.csv").write_text("")
    context, seen = spark.sparkContext, []
    for n in ("c[0-3]*.csv", "*.csv"):  # Spark lists more than 32 files with a job
        context.setJobGroup(f"headers-{n}", n)
        families = chunks.header_families(spark, f"file:{tmp_path}/{n}")
        seen.append(len(context.statusTracker().getJobIdsForGroup(f"headers-{n}")))
        assert set(families) == {("system:index", "B2_t0"), ("system:index", "B2_t1", "note")}
    context.setLocalProperty("spark.jobGroup.id", None)
    assert seen[0] == seen[1]
    assert sum(map(len, families.values())) == 90
    frames = chunks.read_chunks(spark, f"file:{tmp_path}/*.csv")
    assert sorted(f.count() for f in frames) == [15, 30]
