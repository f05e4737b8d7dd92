"""Deterministic order, exact ranks and positions without one task per group.

Every random choice is a function of ``(seed, key)``, so a result does not depend on the
number of partitions. A hash order is uniform, so its leading hex digits cut any group,
however large, into evenly filled slices. Counting the slices first gives each slice its
starting rank; only rows inside a slice are then sorted together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoframe.scale.bounds import materialised, small_table

UNBOUNDED = Window.unboundedPreceding
SLICE_DIGITS = 3  # 16**3 slices per group


def stable_hash(seed: int | str, *parts: Column) -> Column:
    """Hex digest of ``seed`` and key parts, joined with dashes."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_int(digest: Column, word: int = 0) -> Column:
    """The ``word``-th group of eight hex digits as a bigint."""
    return F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("bigint")


def hash_long(digest: Column) -> Column:
    """The leading 60 bits as a bigint."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def uniform(digest: Column, word: int = 0) -> Column:
    """A number in [0, 1) from one group of eight hex digits."""
    return hash_int(digest, word) / F.lit(4294967296.0)


def gaussian(digest: Column) -> Column:
    """A standard normal number from two words of one digest."""
    u = (hash_int(digest, 0) + F.lit(0.5)) / F.lit(4294967296.0)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0) * F.pi() * uniform(digest, 1))


def _on_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on group columns where null is a group like any other."""
    named = right.select(
        *[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"_on_{k}" for k in keys])


def _sliced(df: DataFrame, ids: list[str], seed: int | str, digits: int) -> DataFrame:
    digest = stable_hash(seed, *[F.col(i) for i in ids])
    return df.withColumn("_h", digest).withColumn(
        "_s", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int")
    )


def hash_rank(
    df: DataFrame,
    by: list[str],
    ids: list[str],
    seed: int | str = 42,
    out: str = "rank",
    digits: int = SLICE_DIGITS,
) -> DataFrame:
    """Exact 1-based rank in hash order within ``by``; ``ids`` must identify a row."""
    keyed = _sliced(df, ids, seed, digits)
    slices = keyed.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(UNBOUNDED, -1)
    starts = slices.select(
        *by, "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lo")
    )
    inside = Window.partitionBy(*by, "_s").orderBy("_h", *ids)
    ranked = _on_groups(keyed.withColumn("_r", F.row_number().over(inside)), starts, [*by, "_s"])
    return ranked.select(*df.columns, (F.col("_r") + F.col("_lo")).alias(out))


def hash_segments(
    df: DataFrame,
    by: list[str],
    ids: list[str],
    cuts: list[Column],
    seed: int | str = 42,
    out: str = "segment",
    digits: int = SLICE_DIGITS,
) -> DataFrame:
    """Segment number of every row: how many ``cuts`` lie below its rank in hash order.

    ``cuts`` are ascending ranks, written over the columns ``by`` and the group size ``n``.
    Slice counts show which slice each cut falls into; only those slices are ranked, to find
    the key at the cut. Rows are then placed by comparing their own key with the keys at the
    cuts: the data itself is neither shuffled nor sorted.
    """
    group = by or ["_all"]
    keyed = _sliced(df if by else df.withColumn("_all", F.lit(0)), ids, seed, digits)
    slices = keyed.groupBy(*group, "_s").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*group).orderBy("_s").rowsBetween(UNBOUNDED, 0)
    spans = slices.select(
        *group,
        "_s",
        F.sum("_n").over(running).alias("_hi"),
        (F.sum("_n").over(running) - F.col("_n")).alias("_lo"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("n"),
    )
    stats = []
    for j, cut in enumerate(cuts):
        spans = spans.withColumn(f"_c{j}", cut.cast("bigint"))
        crossed = (F.col("_lo") < F.col(f"_c{j}")) & (F.col(f"_c{j}") < F.col("_hi"))
        stats += [
            F.max(f"_c{j}").alias(f"_c{j}"),
            F.min(F.when(F.col("_lo") >= F.col(f"_c{j}"), F.col("_s"))).alias(f"_beyond{j}"),
            F.max(F.when(crossed, F.col("_s"))).alias(f"_cross{j}"),
            F.max(F.when(crossed, F.col("_lo"))).alias(f"_start{j}"),
        ]
    per_group = small_table(spans.groupBy(*group).agg(*stats))

    n_cuts = range(len(cuts))
    here = [F.coalesce(F.col("_s") == F.col(f"_cross{j}"), F.lit(False)) for j in n_cuts]
    start = F.coalesce(*[F.when(here[j], F.col(f"_start{j}")) for j in n_cuts])
    key = F.struct("_h", *ids)
    ranked = (
        _on_groups(keyed.select(*group, "_s", "_h", *ids), per_group, group)
        .where(reduce(lambda a, b: a | b, here))
        .withColumn(
            "_rank",
            start + F.row_number().over(Window.partitionBy(*group, "_s").orderBy("_h", *ids)),
        )
    )
    ends = [
        F.max(F.when(F.col("_rank") == F.col(f"_c{j}"), key)).alias(f"_key{j}") for j in n_cuts
    ]
    parts = [
        F.col(f"_key{j}.{name}").alias(f"_key{j}_{i}")
        for j in n_cuts
        for i, name in enumerate(["_h", *ids])
    ]
    keys = small_table(ranked.groupBy(*group).agg(*ends).select(*group, *parts))
    places = _on_groups(per_group.select(*group, *[f"_beyond{j}" for j in n_cuts]), keys, group, "left")

    segment = F.lit(0)
    for j in n_cuts:
        at = F.struct(*[F.col(f"_key{j}_{i}").alias(n) for i, n in enumerate(["_h", *ids])])
        after = F.when(F.col(f"_key{j}_0").isNotNull(), key > at).otherwise(
            F.col("_s") >= F.col(f"_beyond{j}")
        )
        segment = segment + F.when(after, 1).otherwise(0)
    return _on_groups(keyed, places, group).select(*df.columns, segment.alias(out))


def sequential_id(df: DataFrame, order: list[str], out: str = "id", start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of ``order``.

    The rows are range-partitioned, sorted and written once; a row's number is its
    place in its partition plus the rows of the partitions before it.
    """
    placed = materialised(
        df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())
    ).withColumn("_p", F.shiftrightunsigned("_m", 33))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(UNBOUNDED, -1)  # one row per partition
    starts = small_table(
        sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lo")),
        1_000_000,
    )
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(starts, "_p").select(
        *df.columns, (F.col("_lo") + place + F.lit(start)).cast("bigint").alias(out)
    )


def slice_of(bounds: Column, value: Column, slices: int) -> Column:
    """How many of the ascending ``bounds`` lie below a value, by halving steps."""
    steps = [1 << k for k in reversed(range(max(1, slices.bit_length())))]

    def advance(found: Column, step: Column) -> Column:
        probe = F.get(bounds, found + step - 1)  # null past the last bound
        return F.when(probe < value, found + step).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def average_ranks(df: DataFrame, columns: list[str], slices: int = 256) -> DataFrame:
    """Average rank of every distinct value of numeric columns: ``(name, value, rank)``.

    Equal values collapse to one counted row first, so ties never gather in a task. The
    distinct values of a column are cut at approximate quantiles and each slice is counted
    and ordered on its own; the ranks stay exact.
    """
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    counted = materialised(
        df.select(cells.alias("_x"))
        .select("_x.*")
        .where(F.col("value").isNotNull())
        .groupBy("name", "value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    shares = [i / slices for i in range(1, slices)]
    bounds = small_table(counted.groupBy("name").agg(F.percentile_approx("value", shares).alias("_b")))
    placed = counted.join(bounds, "name").withColumn(
        "_s", slice_of(F.col("_b"), F.col("value"), slices)
    ).drop("_b")
    sizes = placed.groupBy("name", "_s").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy("name").orderBy("_s").rowsBetween(UNBOUNDED, -1)
    starts = small_table(
        sizes.select("name", "_s", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_lo"))
    )
    inside = Window.partitionBy("name", "_s").orderBy("value").rowsBetween(UNBOUNDED, 0)
    end = F.col("_lo") + F.sum("_n").over(inside)
    return placed.join(starts, ["name", "_s"]).select(
        "name", "value", (end - F.col("_n") + (F.col("_n") + 1) / 2).alias("rank")
    )


def row_ranks(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Average rank of every row's value in each numeric column: ``(key, name, rank)``.

    Values are sorted across range partitions with the key as tie-breaker, so equal values spread
    over tasks. A row's place is its place in its partition plus the rows before. Values that
    cross a border between partitions are at most two per border and column; their places are
    averaged over all partitions they lie in. Values must not be null.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
    placed = rows.select(F.col(key).alias("_key"), cells.alias("_x")).select("_key", "_x.*").orderBy("name", "value", "_key")
    placed = materialised(placed.withColumn("_m", F.monotonically_increasing_id())).withColumn("_part", F.shiftrightunsigned("_m", 33))
    parts = placed.groupBy("name", "_part").agg(
        F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high")
    )
    before = Window.partitionBy("name").orderBy("_part").rowsBetween(UNBOUNDED, -1)
    parts = materialised(parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    starts = parts.select(F.col("name").alias("_of"), F.col("_part").alias("_in"), "_first", "_before")
    at = F.col("_before") + F.col("_m") - F.col("_first") + 1
    counted = placed.join(F.broadcast(starts), (F.col("name") == F.col("_of")) & (F.col("_part") == F.col("_in"))).select(
        "_key", "name", "value", "_part", at.alias("_at")
    )
    same = Window.partitionBy("_part", "name", "value")
    counted = counted.withColumn("_mean", F.avg("_at").over(same))

    edges = parts.select("name", "_part", F.explode(F.array_distinct(F.array("_low", "_high"))).alias("value"))
    crossing = edges.groupBy("name", "value").agg(F.count(F.lit(1)).alias("_p")).where("_p > 1").select("name", "value")
    spread = placed.join(F.broadcast(crossing), ["name", "value"]).join(
        F.broadcast(starts), (F.col("name") == F.col("_of")) & (F.col("_part") == F.col("_in"))
    )
    means = spread.groupBy("name", "value").agg(F.avg(at).alias("_all"))
    joined = counted.join(F.broadcast(materialised(means)), ["name", "value"], "left")
    return joined.select(F.col("_key").alias(key), "name", F.coalesce("_all", "_mean").alias("rank"))


def rows_at_ranks(df: DataFrame, by: str, ids: list[str], picks: DataFrame, seed: int | str = 42, digits: int = SLICE_DIGITS) -> DataFrame:
    """The rows of ``df`` at the ranks ``(by, rank, ...)`` of ``picks`` in hash order within ``by``.

    Counts of hash slices tell which slice a rank falls into, counts of the slices inside those tell
    it more finely, and only rows of the finest slices are sorted. What is shuffled depends on the
    number of picks, not on the rows, of which each is hashed where it is read. Other columns of
    ``picks`` must not be in ``df``; ``by`` must not be null.
    """
    keyed = df.withColumn("_h", stable_hash(seed, *[F.col(i) for i in ids]))
    wanted = materialised(picks.withColumn("_lo", F.lit(0).cast("bigint")).withColumn("_slice", F.lit("")))
    for n in (digits, 2 * digits):
        near = keyed.withColumn("_slice", F.substring("_h", 1, n - digits)) if n > digits else keyed.withColumn("_slice", F.lit(""))
        open_ = materialised(wanted.select(by, "_slice").distinct())
        counted = near.join(open_, [by, "_slice"], "left_semi").groupBy(by, "_slice", F.substring("_h", 1, n).alias("_fine")).agg(F.count(F.lit(1)).alias("_n"))
        running = Window.partitionBy(by, "_slice").orderBy("_fine").rowsBetween(UNBOUNDED, 0)
        counted = counted.withColumn("_hi", F.sum("_n").over(running))
        entry = F.struct("_hi", "_fine", "_n")
        table = counted.groupBy(by, "_slice").agg(F.array_sort(F.collect_list(entry)).alias("_t"))
        place = slice_of(F.col("_t._hi"), F.col("rank") - F.col("_lo"), 16**digits)
        found = wanted.join(table, [by, "_slice"]).withColumn("_e", F.get("_t", place))
        lower = (F.col("_lo") + F.col("_e._hi") - F.col("_e._n")).alias("_lo")
        wanted = materialised(found.select(*picks.columns, lower, F.col("_e._fine").alias("_slice")))
    slices = materialised(wanted.select(F.col(by).alias("_by"), "_slice", F.col("_lo").alias("_start")).distinct())
    inside = Window.partitionBy(by, "_slice").orderBy("_h", *ids)
    near = keyed.withColumn("_fine", F.substring("_h", 1, 2 * digits))
    near = near.join(slices, (F.col(by) == F.col("_by")) & (F.col("_fine") == F.col("_slice")))
    ranked = near.withColumn("rank", F.col("_start") + F.row_number().over(inside)).select(*df.columns, "rank")
    return ranked.join(picks, [by, "rank"])
