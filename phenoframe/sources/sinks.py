"""Dataset, scaler, report and table sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MANIFEST = "version bigint, token string, format string, n_rows bigint, columns string"

SPLITS = ["train", "val", "test"]


def write_splits(samples: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    """The dataset in one folder per split.

    Rows are written where they are: no shuffle, and a split of any size is spread over
    as many files as it has tasks.
    """
    samples.write.mode(mode).partitionBy(split).parquet(path)


def read_splits(spark: SparkSession, path: str, splits: list[str] = SPLITS, split: str = "split") -> DataFrame:
    """Some or all splits of a dataset; other folders are pruned."""
    return spark.read.parquet(path).where(F.col(split).isin(splits))


def write_scaler(scaler: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Scaler state: a table of one row per channel or step and channel."""
    scaler.coalesce(1).write.mode(mode).parquet(path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    """Scaler state for inference."""
    return spark.read.parquet(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row report of counts, maps and structs as JSON."""
    report.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", order: list[str] | None = None) -> None:
    """A flat table as CSV with a header, optionally in order."""
    (df.orderBy(*order) if order else df).write.mode(mode).csv(path, header=True)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The versions of a dataset whose writes are complete, one row each."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def write_version(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = [], order: list[str] | None = None, **options
) -> int:
    """Write a table as the next version of the dataset at ``path`` and return its number.

    The files go to a folder of their own. The version exists once its row is in the manifest, which
    Spark moves into place as one file; a writer that dies before leaves files that nobody reads. Of
    two writers that race for a number the one with the greater token wins. Readers of earlier
    versions are not disturbed.
    """
    spark, token = df.sparkSession, uuid.uuid4().hex
    out = (df.orderBy(*order) if order else df).write.format(fmt).options(**options)
    (out.partitionBy(*partition_by) if partition_by else out).save(f"{path}/data/{token}")
    version = (committed(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    written = spark.read.schema(df.schema).format(fmt).options(**options).load(f"{path}/data/{token}")
    row = [(version, token, fmt, written.count(), df.schema.json())]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def read_version(spark: SparkSession, path: str, version: int | None = None, **options) -> DataFrame:
    """A committed version of a dataset, the latest by default, with the columns it was written with."""
    known = committed(spark, path)
    if version is not None:
        known = known.where(F.col("version") == version)
    found = known.orderBy(F.desc("version"), F.desc("token")).limit(1).collect()
    if not found:
        raise FileNotFoundError(f"no committed version{'' if version is None else f' {version}'} in {path}")
    schema = T.StructType.fromJson(json.loads(found[0]["columns"]))
    return spark.read.schema(schema).format(found[0]["format"]).options(**options).load(f"{path}/data/{found[0]['token']}")
