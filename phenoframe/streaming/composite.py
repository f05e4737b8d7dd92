"""Incremental ten-day composites over a stream of observations."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from phenoframe.functions.masks import finite_or_null
from phenoframe.functions.temporal import bin_start, decadal_bin
from phenoframe.schemas import N_STEPS, STEP_DAYS

ROW, VALUES = 0, 1  # entries that count a bin's rows, and its rows with the same values

# Open bins lie on the executors' disks; all stores of an executor share one bound of native memory, however many they are,
# and none sets disk aside (4 MB each, of both streams while the first one's stores are still loaded).
_STORE = "spark.sql.streaming.stateStore."
STATE_ON_DISK = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}rocksdb.maxMemoryUsageMB": "500",
    f"{_STORE}rocksdb.allowFAllocate": "false",
}


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started inside keep their state on disk; settings that the session has of its own stay.

    A stream takes its settings when it starts. One that goes on from a checkpoint keeps the store it began with.
    """
    added = {k: v for k, v in STATE_ON_DISK.items() if spark.conf.get(k, None) is None}
    try:
        for key, value in added.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key in added:
            spark.conf.unset(key)


def timed_bins(
    obs: DataFrame, keys: list[str], time_col: str, bands: list[str], n_bins: int, bin_days: int, tail: str
) -> DataFrame:
    """Observations with year, bin and the time their bin starts; rows without a bin are left out."""
    number = decadal_bin(F.col(time_col), n_bins, bin_days, tail)
    return obs.select(
        *keys,
        F.year(time_col).alias("year"),
        number.alias("bin"),
        bin_start(F.year(time_col), number, bin_days).cast("timestamp").alias("bin_time"),
        *[finite_or_null(F.col(b)).alias(b) for b in bands],
    ).where(F.col("bin").isNotNull())


def stream_composite(
    obs: DataFrame, keys: list[str], time_col: str, bands: list[str], *,
    lateness: str = "10 days", n_bins: int = N_STEPS, bin_days: int = STEP_DAYS, tail: str = "clamp",
) -> DataFrame:
    """Composites that are emitted once their bin can receive no more observations.

    The bins restart each year, so the event time is the start of an observation's bin and
    not a fixed window. A bin is final when a bin that starts at least ``lateness`` after its
    end has been seen; observations of final bins are left out, and :func:`late_bins` tells
    where. ``observations`` is the number of rows a composite was made from.

    State holds, for open bins only, how often each different observation (its values of all
    bands together) occurred, and the bin's count of rows. So a row adds at most these two
    entries, however many bands there are, rows that repeat add none, and the entries of a pixel
    are spread over all tasks by value. The medians are taken from these counts when the bin closes.
    :func:`run_available` keeps the entries on disk.
    """
    rows = timed_bins(obs, keys, time_col, bands, n_bins, bin_days, tail)
    places = [*keys, "bin_time"]  # the start of a bin tells its year and number
    none = F.struct(F.lit(ROW).alias("kind"), *[F.lit(None).cast("double").alias(f"v{i}") for i in range(len(bands))])
    seen = F.struct(F.lit(VALUES).alias("kind"), *[F.col(b).cast("double").alias(f"v{i}") for i, b in enumerate(bands)])
    known = F.filter(
        F.array(none, seen), lambda e: reduce(lambda a, c: a | c, [e[f"v{i}"].isNotNull() for i in range(len(bands))], e["kind"] == ROW)
    )
    counts = (
        rows.withWatermark("bin_time", f"{24 * bin_days} hours {lateness}")
        .select(*places, F.explode(known).alias("_e"))
        .groupBy(*places, F.col("_e.kind").alias("_kind"), *[F.col(f"_e.v{i}").alias(f"_v{i}") for i in range(len(bands))])
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    medians = [F.percentile(f"_v{i}", 0.5, F.col("_n")).alias(b) for i, b in enumerate(bands)]
    total = F.sum(F.when(F.col("_kind") == ROW, F.col("_n")))
    # entries of a closed bin meet before they become percentile buffers, so there is one set a bin and not one an entry
    closed = counts.repartition(*places).groupBy(*places).agg(
        *medians, (F.count_if(F.col("_kind") == VALUES) > 0).alias("valid"), total.alias("observations")
    )
    number = F.floor((F.dayofyear("bin_time") - 1) / bin_days).cast("int")
    return closed.select(
        *keys, F.year("bin_time").alias("year"), number.alias("bin"), "bin_time", *bands, "valid", "observations"
    )


def late_bins(
    obs: DataFrame, composites: DataFrame, keys: list[str], time_col: str, *,
    lateness: str = "10 days", n_bins: int = N_STEPS, bin_days: int = STEP_DAYS, tail: str = "clamp",
) -> DataFrame:
    """Final bins that observations reached too late, with how many did: ``n_late``.

    ``obs`` is the whole source as a batch and ``composites`` what the stream has made of it,
    with equal parameters and after a run that left nothing unread. A bin all of whose rows
    came late has no composite and is listed too. Null keys are keys like any other.
    """
    bin_keys = [*keys, "year", "bin", "bin_time"]
    seen = timed_bins(obs, keys, time_col, [], n_bins, bin_days, tail)
    micros = int((pd.Timedelta(days=bin_days) + pd.Timedelta(lateness)) / pd.Timedelta(microseconds=1))
    reached = seen.agg(F.max(F.unix_micros("bin_time"))).scalar()
    final = seen.where(F.unix_micros("bin_time") <= reached - micros)
    counted = final.groupBy(*bin_keys).agg(F.count(F.lit(1)).alias("n_late"))
    # what the composites hold is taken off the count: no join, so null keys meet as well
    held = composites.select(*bin_keys, (-F.col("observations")).alias("n_late"))
    left = counted.unionByName(held).groupBy(*bin_keys).agg(F.sum("n_late").alias("n_late"))
    return left.where(F.col("n_late") > 0)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and append final composites to a Parquet folder.

    State lies on disk, so that the memory of an executor does not grow with the open bins.
    """
    writer = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    with state_on_disk(stream.sparkSession):
        return writer.start()
