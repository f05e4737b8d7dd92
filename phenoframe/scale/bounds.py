"""Size checks, heavy keys and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def small_table(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Replace a result of at most ``max_rows`` rows by a local relation.

    At most ``max_rows + 1`` rows reach the driver. A result that fits becomes a local
    relation with an exact size, which Spark broadcasts only below its own threshold. A
    larger one is returned as it was, so that joins with it shuffle.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return df.sparkSession.createDataFrame(rows, schema=df.schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where none is set, a local master gets a temporary folder. On a cluster each executor
    would write to a disk of its own, so there the setting is required.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="phenoframe-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for written tables, next to the checkpoints."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str):
    """A folder for tables that nothing reads after the block; it is deleted at its end, however it ends."""
    folder = new_folder(spark, name)
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialised(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a table to the shared folder once and read it back.

    This cuts lineage like a checkpoint, survives lost executors, and gives later joins the
    real size of the table. Callers that clean up name the ``folder`` to write to.
    """
    path = folder or new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def heavy_keys(df: DataFrame, keys: list[str], max_rows: int) -> DataFrame | None:
    """Keys with more than ``max_rows`` rows, or None when there are none.

    Only the key columns are read and counts are combined before the shuffle.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    heavy = small_table(counted.where(F.col("_n") > max_rows).select(*keys))
    return None if heavy.isEmpty() else heavy
