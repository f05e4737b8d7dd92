"""Wide sample tables exported as CSV chunks."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from phenoframe.operators.align import merge_chunks
from phenoframe.scale.bounds import materialised
from phenoframe.schemas import BANDS, FEATURE, MASK, N_STEPS

# Descriptive columns and their types.
PROPS = {
    "system:index": T.StringType(),
    "crop_label": T.IntegerType(),
    "label": T.IntegerType(),
    "cdl_code": T.IntegerType(),
    "cdl_conf": T.IntegerType(),
    "lon": T.DoubleType(),
    "lat": T.DoubleType(),
    "longitude": T.DoubleType(),
    "latitude": T.DoubleType(),
    "rand": T.DoubleType(),
    ".geo": T.StringType(),
}


def _step(column: str) -> int:
    return int(column.rsplit("_t", 1)[1])


def infer_columns(columns: list[str]) -> tuple[list[str], list[str]]:
    """Series columns by (band, step) and mask columns by step."""
    features = sorted(filter(FEATURE.match, columns), key=lambda c: (c.split("_t")[0], _step(c)))
    return features, sorted(filter(MASK.match, columns), key=_step)


def validate_schema(columns: list[str], bands: list[str] = BANDS, n_steps: int = N_STEPS) -> None:
    """Raise unless the label and every series and mask column are there, and no others."""
    features, masks = infer_columns(columns)
    if "crop_label" not in columns:
        raise ValueError("column 'crop_label' is missing")
    wanted = [f"{b}_t{t}" for b in bands for t in range(n_steps)]
    missing = [c for c in wanted if c not in columns]
    missing += [f"m_t{t}" for t in range(n_steps) if f"m_t{t}" not in columns]
    if missing:
        raise ValueError(f"missing columns: {missing[:10]}")
    if len(features) != len(wanted) or len(masks) != n_steps:
        raise ValueError(
            f"expected {len(wanted)} series and {n_steps} mask columns, "
            f"got {len(features)} and {len(masks)}"
        )


def label_column(columns: list[str]) -> str:
    """Name of the label column."""
    for name in ("crop_label", "label"):
        if name in columns:
            return name
    raise KeyError("no label column: expected 'crop_label' or 'label'")


def coordinate_columns(columns: list[str]) -> tuple[str, str] | None:
    """Names of the coordinate columns, long names first."""
    for pair in (("longitude", "latitude"), ("lon", "lat")):
        if all(c in columns for c in pair):
            return pair
    return None


def csv_schema(header: list[str]) -> T.StructType:
    """Types of a header by naming convention; unknown columns stay text."""

    def kind(column: str) -> T.DataType:
        if FEATURE.match(column):
            return T.FloatType()
        if MASK.match(column):
            return T.DoubleType()
        return PROPS.get(column, T.StringType())

    return T.StructType([T.StructField(c, kind(c)) for c in header])


HEAD_BYTES = 1 << 20  # a longer header is read by Spark


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of each file, null where this process cannot open the store it is in."""
    for batch in batches:
        lines = []
        for path in batch.column(0).to_pylist():
            try:
                url = re.sub("^file:/+", "file:///", path)
                system, name = fs.FileSystem.from_uri(url)
                with system.open_input_stream(name, compression=None) as file:
                    head = file.read(HEAD_BYTES)
                line, *more = head.split(b"\n", 1)
                lines.append(line.decode().rstrip("\r") if more or len(head) < HEAD_BYTES else None)
            except (OSError, ValueError, NotImplementedError):
                lines.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], ["path", "line"])


def header_families(spark: SparkSession, glob: str) -> dict[tuple[str, ...], list[str]]:
    """Files of a glob by header, from one distributed job however many files there are.

    Tasks read the head of each file. Files in a store that only Spark opens are scanned as text once.
    """
    try:
        paths = spark.read.format("binaryFile").load(glob).select("path")
    except AnalysisException as error:
        raise FileNotFoundError(f"no CSV found for {glob}") from error
    heads = materialised(paths.mapInArrow(_first_lines, "path string, line string"))
    unread = heads.where("line IS NULL").select("path")
    if not unread.isEmpty():
        text = spark.read.text(glob).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
        lines = text.withColumn("n", F.monotonically_increasing_id()).where("at = 0")
        first = lines.groupBy("path").agg(F.min_by("value", "n").alias("line"))
        heads = heads.where("line IS NOT NULL").unionByName(first.join(unread, "path", "left_semi"))
    grouped = heads.groupBy("line").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect()
    header = lambda line: tuple(next(csv.reader([line.removeprefix("\ufeff")])))
    families = {header(r["line"]): r["paths"] for r in grouped if r["line"]}
    return dict(sorted(families.items(), key=lambda f: f[1][0]))


def read_chunks(spark: SparkSession, glob: str, order: str | None = None) -> list[DataFrame]:
    """One DataFrame per chunk family: the files of a glob that share a header, by name.

    ``order`` names a column that is added with each row's file and place in it.
    """
    families = header_families(spark, glob)
    if not families:
        raise FileNotFoundError(f"no CSV found for {glob}")
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    frames = []
    for header, group in families.items():
        frame = spark.read.schema(csv_schema(list(header))).option("header", True).csv(group)
        frames.append(frame if order is None else frame.select(*[F.col(f"`{c}`") for c in header], place.alias(order)))
    return frames


def load_samples(spark: SparkSession, glob: str) -> DataFrame:
    """Chunks of a glob merged to one wide row per labelled point; the first row of a key counts."""
    frames = read_chunks(spark, glob, order="_order")
    columns = list(dict.fromkeys(c for f in frames for c in f.columns))
    required = next((c for c in ("crop_label", "label") if c in columns), None)
    props = [p for p in PROPS if p != "system:index"]
    return merge_chunks(frames, "system:index", props, required).drop(".geo", "system:time_start")


def fold_series(df: DataFrame, bands: list[str] = BANDS, n_steps: int = N_STEPS) -> DataFrame:
    """Fold the wide series and mask columns to ``series[t][c]`` and ``mask[t]``.

    An absent series column is 0 everywhere, an absent or missing mask value invalid.
    """

    columns = df.columns
    known = set(columns)

    def value(column: str) -> str:
        return f"CAST(`{column}` AS FLOAT)" if column in known else "CAST(0 AS FLOAT)"

    def flag(column: str) -> str:
        return f"COALESCE(`{column}`, 0) > 0.5" if column in known else "false"

    steps = range(n_steps)
    wanted = {f"{b}_t{t}" for b in bands for t in steps}
    folded = {c for c in columns if FEATURE.match(c) or MASK.match(c) or c in wanted}
    rest = [F.col(f"`{c}`") for c in columns if c not in folded]
    # One SQL expression each: hundreds of columns would cost as many calls to build.
    rows = [f"array({', '.join(value(f'{b}_t{t}') for b in bands)})" for t in steps]
    series = F.expr(f"array({', '.join(rows)})")
    mask = F.expr(f"array({', '.join(flag(f'm_t{t}') for t in steps)})")
    return df.select(*rest, series.alias("series"), mask.alias("mask"))
