"""Canonical table schemas and the fixed values results depend on."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Spectral bands, time grid, scene classes that hide the ground.
BANDS = ["B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12"]
N_STEPS = 36
STEP_DAYS = 10
CLOUD_SCENE_CLASSES = [1, 3, 8, 9, 10, 11]
CHUNK_STEPS = [(0, 8), (9, 17), (18, 26), (27, 35)]

# Class names and crop codes of the two regions.
CALIFORNIA_CLASSES = {
    0: "Grapes", 1: "Rice", 2: "Alfalfa", 3: "Almonds", 4: "Pistachios", 5: "Others",
}
ARKANSAS_CLASSES = {0: "Corn", 1: "Cotton", 2: "Soybean", 3: "Rice", 4: "Others"}
CALIFORNIA_CODES = {69: 0, 3: 1, 36: 2, 75: 3, 204: 4}
ARKANSAS_CODES = {1: 0, 2: 1, 5: 2, 3: 3}
CALIFORNIA_QUOTAS = {0: 2054, 1: 2037, 2: 974, 3: 783, 4: 640, 5: 3512}

# Areas of interest (west, south, east, north) and eligibility limits.
CALIFORNIA_AREAS = [(-122.8, 38.2, -121.2, 39.8), (-121.0, 36.0, -119.6, 37.2)]
CROPLAND_CLASS = 40
MIN_CONFIDENCE_EXCLUSIVE = 85
MIN_CONFIDENCE_INCLUSIVE = 95
MIN_VALID_STEPS = 8

# Covariate groups and the order of the radar channels.
TOPO = ["elevation", "slope", "aspect"]
SOIL = ["clay", "sand", "silt", "ph"]
CLIMATE = ["temp_max", "temp_min", "precip_sum"]
COVARIATES = TOPO + SOIL + CLIMATE
RADAR_CHANNELS = ["ratio", "vh", "vv"]


def observations(bands: list[str] = BANDS) -> T.StructType:
    """One row per pixel and acquisition, one column per band."""
    return T.StructType(
        [T.StructField("pixel_id", T.LongType()), T.StructField("obs_date", T.DateType())]
        + [T.StructField(b, T.FloatType()) for b in bands]
        + [T.StructField("scl", T.IntegerType())]
    )


def chunk_csv(first: int, last: int, bands: list[str] = BANDS) -> T.StructType:
    """One exported chunk of the wide sample table."""
    props = [
        T.StructField("system:index", T.StringType()),
        T.StructField("crop_label", T.IntegerType()),
        T.StructField("cdl_code", T.IntegerType()),
        T.StructField("cdl_conf", T.IntegerType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("rand", T.DoubleType()),
        T.StructField(".geo", T.StringType()),
    ]
    steps = range(first, last + 1)
    values = [T.StructField(f"{b}_t{t}", T.FloatType()) for t in steps for b in bands]
    masks = [T.StructField(f"m_t{t}", T.ByteType()) for t in steps]
    return T.StructType(props + values + masks)


def samples() -> T.StructType:
    """One row per pixel: series[t][c], mask[t], class, zone and split."""
    return T.StructType(
        [
            T.StructField("pixel_id", T.LongType()),
            T.StructField("series", T.ArrayType(T.ArrayType(T.FloatType()))),
            T.StructField("mask", T.ArrayType(T.BooleanType())),
            T.StructField("y", T.IntegerType()),
            T.StructField("zone", T.IntegerType()),
            T.StructField("split", T.StringType()),
        ]
    )


POINTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
    ]
)

RADAR_CSV = T.StructType(
    [T.StructField("id", T.StringType())]
    + [
        T.StructField(f"{c}_{m:02d}", T.DoubleType())
        for m in range(1, 13)
        for c in RADAR_CHANNELS
    ]
)

COVARIATES_CSV = T.StructType(
    [T.StructField("id", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in COVARIATES]
)

# Fixed patterns: series and mask columns of the wide table.
FEATURE = re.compile(r"^B\d{1,2}A?_t\d+$")
MASK = re.compile(r"^m_t\d+$")
