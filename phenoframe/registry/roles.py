"""The given tables in the roles of the data model, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoframe.operators.composite import decadal_composite, dense_series, series_to_long
from phenoframe.operators.filters import clear_scenes
from phenoframe.scale.bounds import small_table

BANDS = ["green", "red", "nir", "swir"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_ctes(*ctes: str, body: str) -> str:
    """A query over common table expressions; a body that starts with a comma adds more."""
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


# Observations: supplier as pixel, ship date as acquisition, four measures as bands.
OBS = """obs AS (
  SELECT l_suppkey AS pixel_id, CAST(l_shipdate AS DATE) AS obs_date,
         NULLIF(l_discount * 10000, 0) AS green, l_quantity * 100 AS red,
         l_extendedprice / 10 AS nir, NULLIF(l_tax * 10000, 0) AS swir,
         CASE l_returnflag WHEN 'A' THEN 4 WHEN 'R' THEN 5 ELSE 8 END AS scl
  FROM lineitem)"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return observations_of(table(spark, sf, "lineitem"))


def observations_of(lineitem: DataFrame) -> DataFrame:
    """Batch or streaming line items as observations."""
    flag = F.col("l_returnflag")
    return lineitem.select(
        F.col("l_suppkey").alias("pixel_id"),
        F.col("l_shipdate").cast("date").alias("obs_date"),
        F.nullif(F.col("l_discount") * 10000, F.lit(0.0)).alias("green"),
        (F.col("l_quantity") * 100).alias("red"),
        (F.col("l_extendedprice") / 10).alias("nir"),
        F.nullif(F.col("l_tax") * 10000, F.lit(0.0)).alias("swir"),
        F.when(flag == "A", 4).when(flag == "R", 5).otherwise(8).alias("scl"),
    )


# Ten-day composites of the clear observations of every year.
COMP = """comp AS (
  SELECT pixel_id, CAST(year(obs_date) AS INT) AS year,
         CAST(least((dayofyear(obs_date) - 1) // 10, 35) AS INT) AS bin,
         median(green) AS green, median(red) AS red, median(nir) AS nir, median(swir) AS swir,
         count(COALESCE(green, red, nir, swir)) > 0 AS valid
  FROM obs WHERE scl NOT IN (1, 3, 8, 9, 10, 11) GROUP BY ALL)"""


def composites(spark: SparkSession, sf: str) -> DataFrame:
    clear = clear_scenes(observations(spark, sf))
    return decadal_composite(clear, ["pixel_id"], "obs_date", BANDS)


# Every step of every pixel and year, null where nothing was seen.
DENSE = """dense AS (
  SELECT k.pixel_id, k.year, k.t, green, red, nir, swir, COALESCE(valid, false) AS valid
  FROM (SELECT pixel_id, year, CAST(unnest(range(36)) AS INT) AS t
        FROM (SELECT DISTINCT pixel_id, year FROM comp)) k
  LEFT JOIN comp c ON c.pixel_id = k.pixel_id AND c.year = k.year AND c.bin = k.t)"""


def samples(spark: SparkSession, sf: str, empty: float | None = None) -> DataFrame:
    """One row per pixel and year with ``series`` and ``mask``."""
    return dense_series(composites(spark, sf), ["pixel_id", "year"], BANDS, empty=empty)


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return series_to_long(samples(spark, sf), ["pixel_id", "year"], BANDS)


# Class of a pixel: the region of its nation, the nation being its code.
PIXEL = """pixel AS (
  SELECT s_suppkey AS pixel_id, s_nationkey AS code, n_regionkey AS y, s_acctbal AS elevation
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    return (
        table(spark, sf, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("pixel_id"),
            F.col("s_nationkey").alias("code"),
            F.col("n_regionkey").alias("y"),
            F.col("s_acctbal").alias("elevation"),
        )
    )


def pixel_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of pixels, with an exact size when they are few."""
    return small_table(pixels(spark, sf).select("pixel_id", "y"))


# Labelled points: orders with five uneven classes and three zones.
PTS = """pts AS (
  SELECT o_orderkey AS id, o_totalprice AS price,
         CASE WHEN o_totalprice < 300000 THEN 0 WHEN o_totalprice < 400000 THEN 1
              WHEN o_totalprice < 450000 THEN 2 WHEN o_totalprice < 480000 THEN 3
              ELSE 4 END AS y,
         CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS zone
  FROM orders)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        price.alias("price"),
        F.when(price < 300000, 0).when(price < 400000, 1).when(price < 450000, 2)
        .when(price < 480000, 3).otherwise(4).alias("y"),
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("zone"),
    )


# Series of sixteen steps and four channels; values close to zero count as missing.
TENSOR = """tensor AS (
  SELECT vec_id, label, CAST(i // 4 AS INT) AS t, CAST(i % 4 AS INT) AS c,
         CASE WHEN abs(CAST(embedding[i + 1] AS DOUBLE)) >= 0.03
              THEN CAST(embedding[i + 1] AS DOUBLE) END AS x
  FROM (SELECT vec_id, label, embedding, unnest(range(64)) AS i FROM embeddings))"""

TENSOR_STEPS = 16
TENSOR_CHANNELS = 4


def tensors(spark: SparkSession, sf: str) -> DataFrame:
    def value(i: int):
        x = F.get("embedding", F.lit(i)).cast("double")
        return F.when(F.abs(x) >= 0.03, x)

    series = F.array(
        *[
            F.array(*[value(4 * t + c) for c in range(TENSOR_CHANNELS)])
            for t in range(TENSOR_STEPS)
        ]
    )
    return table(spark, sf, "embeddings").select("vec_id", "label", series.alias("series"))


def tensor_rows(df: DataFrame, keys: list[str], column: str = "series", value: str = "x") -> DataFrame:
    """A series column as one row per step and channel."""
    steps = df.select(*keys, F.posexplode_outer(column).alias("t", "_s"))
    return steps.select(*keys, "t", F.posexplode_outer("_s").alias("c", value))


# Predictions: softmax of the first ten entries as scores of ten classes.
PRED = """scores AS (
  SELECT vec_id, label AS y, list_transform(embedding[1:10], lambda v: exp(5 * CAST(v AS DOUBLE))) AS e
  FROM embeddings),
pred AS (
  SELECT vec_id, y, list_transform(e, lambda v: v / list_sum(e)) AS proba,
         CAST(list_position(e, list_max(e)) - 1 AS INT) AS y_pred FROM scores)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    from phenoframe.functions.labels import argmax_class

    powers = F.transform(F.slice("embedding", 1, 10), lambda v: F.exp(F.lit(5) * v.cast("double")))
    total = F.aggregate("e", F.lit(0.0), lambda acc, v: acc + v)
    scores = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("y"), powers.alias("e"))
    return (
        scores.withColumn("total", total)
        .select("vec_id", "y", F.transform("e", lambda v: v / F.col("total")).alias("proba"))
        .withColumn("y_pred", argmax_class(F.col("proba")))
    )
