"""Splits, stratified samples and draws with replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoframe.functions.labels import mapped
from phenoframe.scale.bounds import materialised, small_table
from phenoframe.scale.ranks import hash_int, hash_long, hash_rank, hash_segments, rows_at_ranks, sequential_id, stable_hash


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    labels = F.array(*[F.lit(n) for n in names])
    return df.withColumn("split", F.get(labels, F.col("split")))


def paper_split(
    df: DataFrame, y: str, ids: list[str], n_train: int = 240, n_val: int = 60, seed: int = 42
) -> DataFrame:
    """Fixed train and validation counts per class, the rest test."""
    cuts = [F.least(F.lit(n_train), F.col("n")), F.least(F.lit(n_train + n_val), F.col("n"))]
    return _named(hash_segments(df, [y], ids, cuts, seed, "split"), ["train", "val", "test"])


def ratio_split(
    df: DataFrame, by: list[str], ids: list[str], test: float = 0.15, val: float = 0.15, seed: int = 42
) -> DataFrame:
    """Test and validation shares of every stratum, the rest train."""
    first = F.floor(F.col("n") * F.lit(test) + F.lit(0.5))
    second = F.floor(F.col("n") * F.lit(test + val) + F.lit(0.5))
    return _named(hash_segments(df, by, ids, [first, second], seed, "split"), ["test", "val", "train"])


def zone_split(
    df: DataFrame, y: str, zone: str, ids: list[str], val: float = 0.2, seed: int = 42
) -> DataFrame:
    """Validation share of every class and zone, the rest train."""
    cut = F.floor(F.col("n") * F.lit(val) + F.lit(0.5))
    return _named(hash_segments(df, [y, zone], ids, [cut], seed, "split"), ["val", "train"])


def _first(df: DataFrame, by: list[str], ids: list[str], n: Column, seed: int) -> DataFrame:
    return hash_segments(df, by, ids, [n], seed, "_seg").where(F.col("_seg") == 0).drop("_seg")


def quota_sample(
    df: DataFrame, y: str, ids: list[str], quotas: dict[int, int], seed: int = 42
) -> DataFrame:
    """Up to a given number of rows per class; other classes are left out."""
    listed = df.where(F.col(y).isin(list(quotas)))
    return _first(listed, [y], ids, F.least(mapped(F.col(y), quotas), F.col("n")), seed)


def uniform_sample(df: DataFrame, ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, all of them when there are fewer."""
    return _first(df, [], ids, F.least(F.lit(n), F.col("n")), seed)


def equal_sample(df: DataFrame, y: str, ids: list[str], max_samples: int, seed: int = 42) -> DataFrame:
    """The same number of rows per class without replacement, ``max_samples`` at most."""
    labelled = df.where(F.col(y) >= 0)
    classes = labelled.agg(F.countDistinct(y)).first()[0]
    per_class = max(1, max_samples // max(1, classes))
    picked = _first(labelled, [y], ids, F.least(F.lit(per_class), F.col("n")), seed)
    return picked if classes <= max_samples else uniform_sample(picked, ids, max_samples, seed)


def _draw(
    df: DataFrame, y: str, ids: list[str], counts: DataFrame, widest: int, seed: int, per_task: int,
    rare: bool = False,
) -> DataFrame:
    """Fill ``take`` slots per class with hashed picks of its ``n`` rows.

    ``counts`` holds ``(y, n, take)``. Slots are numbered rows of a distributed range. When
    a class has few rows for its slots, its rows are copied under several salts so that no
    join key receives more than about ``per_task`` slots. With ``rare`` slots are few for
    the rows, and only hash slices that a pick falls into are ranked.
    """
    spark = df.sparkSession
    salts = F.ceil(F.col("take") / (F.col("n") * F.lit(per_task)))
    table = counts.withColumn("_salts", F.greatest(salts, F.lit(1)))
    few = small_table(table)
    if few is table:
        numbered = sequential_id(table, [y], "_c")
        n_classes = table.count()
    else:
        numbered = few.withColumn("_c", (F.row_number().over(Window.orderBy(y)) - 1).cast("bigint"))
        n_classes = few.count()
    slots = (
        spark.range(n_classes * widest)
        .select(
            F.floor(F.col("id") / F.lit(widest)).alias("_c"),
            F.pmod(F.col("id"), F.lit(widest)).alias("slot"),
        )
        .join(numbered, "_c")
        .where(F.col("slot") < F.col("take"))
    )
    digest = stable_hash(seed, F.col(y), F.col("slot"))
    picks = slots.select(
        y,
        "slot",
        (F.pmod(hash_long(digest), F.col("n")) + 1).alias("rank"),
        F.pmod(hash_int(digest, 3), F.col("_salts")).alias("_salt"),
    )
    if rare:
        return rows_at_ranks(df, y, ids, picks.drop("_salt"), seed).select(*df.columns, "slot")
    pool = hash_rank(df, [y], ids, seed, "rank").join(numbered.select(y, "_salts"), y)
    copies = pool.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1))
    ).drop("_salts")
    return picks.join(copies, [y, "rank", "_salt"]).select(*df.columns, "slot")


def replacement_sample(
    df: DataFrame, y: str, ids: list[str], min_per_class: int = 2000, max_samples: int = 10_000,
    seed: int = 42, per_task: int = 100_000,
) -> DataFrame:
    """``min(min_per_class, n)`` draws with replacement per class, ``max_samples`` at most."""
    labelled = df.where(F.col(y) >= 0)
    counts = labelled.groupBy(y).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "take", F.least(F.lit(min_per_class), F.col("n"))
    )
    drawn = _draw(labelled, y, ids, counts, min_per_class, seed, per_task, rare=min_per_class <= per_task)
    return uniform_sample(drawn, [y, "slot"], max_samples, seed)


def oversample_balanced(
    df: DataFrame, y: str, ids: list[str], seed: int = 42, per_task: int = 100_000
) -> DataFrame:
    """Draws with replacement until every class has as many rows as the largest."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    target = counts.agg(F.max("n")).first()[0]
    counts = counts.withColumn("take", F.lit(target).cast("bigint"))
    return _draw(df.where(F.col(y).isNotNull()), y, ids, counts, target, seed, per_task)


def read_sampled(observations: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Observations of the sampled points only: sample labels first, read series later."""
    # written once, so that its real size decides whether it is broadcast
    return observations.join(materialised(points.select(*keys).distinct()), keys, "left_semi")


def hash_ordered(df: DataFrame, ids: list[str], seed: int = 42) -> DataFrame:
    """Rows in a reproducible random order, for sinks."""
    return df.orderBy(stable_hash(seed, *[F.col(i) for i in ids]), *ids)
