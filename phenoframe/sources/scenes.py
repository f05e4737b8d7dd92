"""Scene lists and band-file catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoframe.functions.temporal import acquisition_date

# Resolution folders by preference.
RESOLUTIONS = ["R10m", "R20m"]


def scene_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Scene paths and dates from text lines; blanks and ``#`` comments are dropped."""
    path = F.trim(F.col(value))
    kept = lines.where((path != "") & ~path.startswith("#")).select(path.alias("scene_path"))
    name = F.element_at(F.split("scene_path", "/"), -1)
    return kept.withColumn("acq_date", acquisition_date(name))


def read_scene_list(spark: SparkSession, path: str) -> DataFrame:
    """A scene list file in order of acquisition."""
    return scene_lines(spark.read.text(path)).orderBy("acq_date", "scene_path")


def list_band_files(spark: SparkSession, glob: str) -> DataFrame:
    """Paths of band files below scene folders; file contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob).select(
        F.col("path").alias("file_path")
    )


def band_catalog(files: DataFrame, path: str = "file_path", preferred: str = "R10m") -> DataFrame:
    """The file of every scene and band: first granule, preferred resolution first.

    Works on ``.../<scene>/GRANULE/L2A_*/IMG_DATA/<resolution>/*_B<band>_*.jp2`` paths.
    """
    p = F.col(path)
    order = [preferred, *[r for r in RESOLUTIONS if r != preferred]]
    parts = files.select(
        F.regexp_extract(p, r"([^/]+)/GRANULE/", 1).alias("scene"),
        F.regexp_extract(p, r"/GRANULE/(L2A_[^/]*)/", 1).alias("granule"),
        F.regexp_extract(p, r"/IMG_DATA/([^/]+)/", 1).alias("resolution"),
        F.upper(F.regexp_extract(p, r"(?i)_B([0-9A]+)_[^/]*\.jp2$", 1)).alias("band"),
        p.alias("file_path"),
    ).where((F.col("scene") != "") & (F.col("granule") != "") & (F.col("band") != ""))
    rank = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("resolution"))
    ranked = parts.withColumn("rank", rank).where(F.col("rank") > 0)
    granule = ranked.groupBy("scene").agg(F.min("granule").alias("granule"))
    best = F.min(F.struct("rank", "file_path", "resolution")).alias("b")
    return (
        ranked.join(granule, ["scene", "granule"], "left_semi")
        .groupBy("scene", F.concat(F.lit("B"), F.col("band")).alias("band"))
        .agg(best)
        .select("scene", "band", "b.resolution", "b.file_path")
    )


def missing_bands(catalog: DataFrame, required: list[str]) -> DataFrame:
    """Required bands a scene lacks: ``(scene, band)``."""
    wanted = F.array(*[F.lit(b) for b in required])
    present = F.collect_set(F.when(F.col("band").isin(required), F.col("band")))
    return catalog.groupBy("scene").agg(F.array_except(wanted, present).alias("m")).select(
        "scene", F.explode("m").alias("band")
    )


def require_bands(catalog: DataFrame, required: list[str]) -> DataFrame:
    """The catalog, failing on the first scene without all required bands."""
    absent = missing_bands(catalog, required).limit(1).collect()
    if absent:
        raise KeyError(f"scene {absent[0]['scene']} lacks band {absent[0]['band']}")
    return catalog
