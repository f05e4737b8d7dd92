"""Raster tables, points, covariates, radar and code mappings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoframe.functions.masks import nodata_to_null
from phenoframe.scale.ranks import sequential_id
from phenoframe.sources.chunks import csv_schema, read_chunks


def read_raster_table(
    spark: SparkSession, path: str, bands: list[str], nodata: float | None = None
) -> DataFrame:
    """A raster stored as ``(tile_id, row, col, band...)``; nodata becomes null."""
    table = spark.read.parquet(path)
    return raster_values(table, bands, nodata)


def raster_values(table: DataFrame, bands: list[str], nodata: float | None = None) -> DataFrame:
    """Null the nodata value of the bands."""
    if nodata is None:
        return table
    return table.withColumns({b: nodata_to_null(F.col(b), nodata) for b in bands})


def _csv(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.option("header", True).csv(path).columns
    return spark.read.schema(csv_schema(header)).option("header", True).csv(path)


def read_points(spark: SparkSession, path: str, chunk_glob: str) -> DataFrame:
    """Points with ids: the points file, else the distinct points of the sample chunks."""
    try:
        table = _csv(spark, path)
    except AnalysisException:
        frames = [
            f.select("system:index", "lon", "lat")
            for f in read_chunks(spark, chunk_glob)
            if {"system:index", "lon", "lat"} <= set(f.columns)
        ]
        if not frames:
            raise FileNotFoundError(f"no points in {path} or {chunk_glob}") from None
        table = frames[0]
        for frame in frames[1:]:
            table = table.unionByName(frame)
    return identified_points(table)


def identified_points(table: DataFrame) -> DataFrame:
    """Located points with a bigint id, one per key; without a key column every row is a point.

    An ``id`` column is used as it is; a ``system:index`` that is a number in at least half
    of the rows serves as id; otherwise, and where the number is missing, points are
    numbered in a fixed order, above the numbers that are there.
    """
    table = table.dropna(subset=["lon", "lat"])
    key = next((c for c in ("id", "system:index") if c in table.columns), None)
    if key is None:
        order = ["lon", "lat"]
        points = table.select("lon", "lat")
    else:
        order = [key]
        points = table.groupBy(key).agg(F.min(F.struct("lon", "lat")).alias("p")).select(
            key, "p.lon", "p.lat"
        )
    if key is not None:
        whole = F.coalesce(
            F.col(key).try_cast("bigint"), F.col(key).try_cast("double").try_cast("bigint")
        )
        counts = points.agg(F.count(F.lit(1)), F.count(whole)).first()
        if key == "id" or counts[1] >= max(1, counts[0] // 2):
            named = points.withColumn("_id", whole)
            if counts[1] == counts[0]:
                return named.select(F.col("_id").alias("id"), "lon", "lat")
            highest = named.agg(F.max("_id")).first()[0]
            above = 0 if highest is None else highest + 1
            numbered = sequential_id(named, order, "_n", above)
            return numbered.select(F.coalesce("_id", "_n").alias("id"), "lon", "lat")
    return sequential_id(points, order, "id").select("id", "lon", "lat")


def read_numeric_csv(spark: SparkSession, path: str, keys: tuple[str, ...] = ("id", "system:index")) -> DataFrame:
    """A CSV of key columns and numbers (covariates, monthly radar), typed by header."""
    header = spark.read.option("header", True).csv(path).columns
    kinds = ", ".join(f"`{c}` {'STRING' if c in keys else 'DOUBLE'}" for c in header)
    return spark.read.schema(kinds).option("header", True).csv(path)


def read_mapping(spark: SparkSession, path: str, code: str = "code", value: str = "class_id") -> DataFrame:
    """A JSON object ``{code: class}`` as a two-column table."""
    text = spark.read.option("wholetext", True).text(path)
    pairs = F.explode(F.from_json("value", "MAP<STRING, INT>")).alias(code, value)
    return text.select(pairs).select(F.col(code).cast("int").alias(code), value)


def static_columns(columns: list[str], exclude=("id", "lon", "lat", "system:index")) -> list[str]:
    """Covariate columns: everything that is not a key or a coordinate."""
    found = [c for c in columns if c not in exclude]
    if not found:
        raise ValueError("no static covariates found")
    return found
