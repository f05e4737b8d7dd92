"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept. The first four return the columns of
``documents``; the last returns the packing, one row per piece of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoframe.llm import packing, pii, postings, quality, simhash
from phenoframe.scale.bounds import materialised, scratch

# Ranking, near-duplicate groups and packing are not expressible in SQL; the tests compare
# every stage with a brute-force version.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written once with a row key, so that rows with equal ids stay apart.

    Returns the key's name too, which no column has, in upper or lower case.
    """
    taken, key = {c.lower() for c in docs.columns}, "_key"
    while key in taken:
        key += "_"
    return materialised(docs.withColumn(key, F.monotonically_increasing_id())), key


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the pairwise ranking scores as good."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that with the smallest id."""
    keyed, key = _keyed(docs)
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    groups = simhash.simhash_groups(keyed.select(name.alias("name"), "text"), "name")
    dropped = materialised(groups.where("doc_id.key <> component_id.key").select(F.col("doc_id.key").alias(key)))
    return keyed.join(dropped, key, "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    keyed, key = _keyed(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    with scratch(spark, "index") as folder:
        found = postings.decontaminate(keyed, items, key, folder=folder)
        dropped = materialised(found.where("contaminated").select(F.col("doc_id").alias(key)))
    return keyed.join(dropped, key, "left_anti").select(docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts; ``n_chars`` follows the new text."""
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole of ``documents``; what each returns is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
