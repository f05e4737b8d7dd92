"""Datasets, scalers, reports and tables written in versions and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.operators.audit import summary_report
from phenoframe.operators.scaling import apply_column_scaler, fit_column_scaler
from phenoframe.registry.base import query, r, rounded, sr
from phenoframe.registry.roles import PTS, TENSOR, points, table, tensors, with_ctes
from phenoframe.scale.bounds import new_folder
from phenoframe.scale.ranks import sequential_id
from phenoframe.sources.sinks import committed, read_version, write_version


def abandoned(df, path: str) -> None:
    """What a writer leaves that dies before its commit."""
    df.write.parquet(f"{path}/data/abandoned")


# The points of each zone as a split, the series of vectors beside them.
@query("split_round_trip", with_ctes(TENSOR, body="""
SELECT vec_id, CASE label % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, t, c, x FROM tensor WHERE label % 3 < 2"""))
def split_round_trip(spark, sf):
    """The second version of a dataset, of which two splits are read back."""
    path = new_folder(spark, "dataset")
    names = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
    rows = tensors(spark, sf).withColumn("split", F.get(names, F.col("label") % 3))
    write_version(rows.where("vec_id % 2 = 0"), path, partition_by=["split"])
    write_version(rows, path, partition_by=["split"])
    abandoned(rows.limit(1), path)
    back = read_version(spark, path).where(F.col("split").isin("train", "val"))
    steps = back.select("vec_id", "split", F.posexplode("series").alias("t", "s"))
    return steps.select("vec_id", "split", "t", F.posexplode("s").alias("c", "x"))


@query("scaler_round_trip", f"""
WITH f AS (SELECT avg(p_retailprice) AS mp, stddev_pop(p_retailprice) AS sp, avg(p_size) AS ms, stddev_pop(p_size) AS ss FROM part WHERE p_partkey % 4 > 0)
SELECT p_partkey AS id, {sr('(p_retailprice - mp) / sp', 'price', 5)}, {sr('(p_size - ms) / ss', 'size', 5)} FROM part, f""")
def scaler_round_trip(spark, sf):
    """A scaler fitted on training rows, stored, and applied after it is read back."""
    path = new_folder(spark, "scaler")
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"),
        F.when(F.col("p_partkey") % 4 > 0, "train").otherwise("test").alias("split"),
    )
    write_version(fit_column_scaler(rows, ["price", "size"]), path)
    scaled = apply_column_scaler(rows, read_version(spark, path), ["price", "size"])
    return rounded(scaled.drop("split"), ["price", "size"], 5)


@query("report_round_trip", with_ctes(PTS, body="""
, codes AS (SELECT zone AS code, count(*) AS n FROM pts GROUP BY zone ORDER BY n DESC, code LIMIT 2)
SELECT count(*) AS n_rows, count(DISTINCT zone) AS n_codes, count(DISTINCT y) AS n_classes,
  (SELECT string_agg(y || '=' || n, ',' ORDER BY y) FROM (SELECT y, count(*) AS n FROM pts GROUP BY y)) AS classes,
  (SELECT string_agg(code || '=' || n, ',' ORDER BY n DESC, code) FROM codes) AS codes FROM pts"""))
def report_round_trip(spark, sf):
    """A report with maps and lists of structs as JSON, read back with its own types."""
    path = new_folder(spark, "report")
    write_version(summary_report(points(spark, sf), "y", "zone", 2), path, fmt="json")
    back = read_version(spark, path)
    pairs = F.array_sort(F.map_entries("class_counts"))
    named = lambda a, b: F.concat_ws("=", a, b.cast("string"))
    return back.select(
        "n_rows", "n_codes", "n_classes",
        F.array_join(F.transform(pairs, lambda e: named(e["key"], e["value"])), ",").alias("classes"),
        F.array_join(F.transform("top_codes", lambda e: named(e["code"], e["n"])), ",").alias("codes"),
    )


@query("table_round_trip", with_ctes(PTS, body=f"""
SELECT id, {sr('price', 'price', 2)}, y, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN '' ELSE 'a "b", c' || id END AS note,
  CAST(row_number() OVER (ORDER BY price DESC, id) AS BIGINT) AS place FROM pts"""))
def table_round_trip(spark, sf):
    """An ordered CSV table with a header, empty and quoted texts; its order is kept."""
    path = new_folder(spark, "table")
    note = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, "").otherwise(F.concat(F.lit('a "b", c'), F.col("id").cast("string")))
    rows = points(spark, sf).select("id", "price", "y", note.alias("note"))
    text = {"header": "true", "nullValue": "\\N", "escape": '"'}
    number = write_version(rows, path, "csv", order=[F.desc("price"), F.col("id")], **text)
    assert committed(spark, path).count() == number == 1
    back = read_version(spark, path, number, **text)
    placed = sequential_id(back.withColumn("_down", -F.col("price")), ["_down", "id"], "place", start=1)
    return placed.select("id", r("price", 2).alias("price"), "y", "note", "place")
