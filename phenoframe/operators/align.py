"""Joins that bring chunks, modalities, labels and rasters together by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from phenoframe.functions.geo import cell, centre
from phenoframe.operators.cover import points_in_tiles
from phenoframe.scale.ranks import sequential_id
from phenoframe.schemas import FEATURE, MASK


def merge_chunks(
    chunks: list[DataFrame], key: str, props: list[str], required: str | None = None, order: str = "_order"
) -> DataFrame:
    """One row per key from exported chunks that each hold some steps of the series.

    Of rows of a chunk with the same key the first counts, as a whole: by the column ``order`` where
    a chunk has it, else in the order of its scan. Properties come from the first chunk that has the
    key; series columns from the first chunk with a value, null where there is none. Mask columns default
    to 0. The chunks are stacked as one struct each and grouped once.
    """
    parts, held = [], []
    for i, chunk in enumerate(chunks):
        own = [c for c in chunk.columns if c != key and (c in props or FEATURE.match(c) or MASK.match(c))]
        place = F.col(order) if order in chunk.columns else F.monotonically_increasing_id()
        row = F.expr(f"struct({', '.join(['true AS `_here`', *[f'`{c}`' for c in own]])})")
        parts.append(chunk.select(f"`{key}`", place.alias(f"_o{i}"), row.alias(f"_c{i}")))
        held.append(own)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    n = range(len(chunks))
    firsts = stacked.groupBy(key).agg(*[F.min_by(f"_c{i}", f"_o{i}").alias(f"_c{i}") for i in n])

    def prop(name: str) -> str:
        cases = [f"WHEN _c{i} IS NOT NULL THEN {f'_c{i}.`{name}`' if name in held[i] else 'NULL'}" for i in n]
        return f"CASE {' '.join(cases)} END AS `{name}`"

    def step(name: str) -> str:
        values = [f"_c{i}.`{name}`" for i in n if name in held[i]] + ["0"] * bool(MASK.match(name))
        return f"COALESCE({', '.join(values)}) AS `{name}`"

    every = list(dict.fromkeys(c for own in held for c in own))
    kept, steps = [p for p in props if p in every], [c for c in every if c not in props]
    out = firsts.select(F.col(f"`{key}`"), *[F.expr(e) for e in [*map(prop, kept), *map(step, steps)]])
    return out.dropna(subset=[required]) if required else out


def coerce_id(df: DataFrame, id_col: str) -> DataFrame:
    """Numeric ids as bigint; rows whose id is not a number are dropped."""
    whole = F.col(id_col).try_cast("bigint")
    number = F.coalesce(whole, F.col(id_col).try_cast("double").try_cast("bigint"))
    return df.withColumn(id_col, number).dropna(subset=[id_col])


def inner_by_id(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Inner join on id; columns the left side already has are not repeated."""
    extra = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(id_col, *extra), id_col)


def left_by_id(left: DataFrame, right: DataFrame, id_col: str, fill: float | None = None) -> DataFrame:
    """Left join on id, optionally with a constant for a missing modality."""
    extra = [c for c in right.columns if c not in left.columns]
    joined = left.join(right.select(id_col, *extra), id_col, "left")
    if fill is None:
        return joined
    return joined.select(*left.columns, *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in extra])


def zero_modality(ids: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Stand-in for an absent modality: zeros for every id."""
    return ids.select(id_col, *[F.lit(0.0).alias(c) for c in columns])


def unknown_ids(df: DataFrame, known: DataFrame, id_col: str, show: int = 8) -> DataFrame:
    """The first ids that have no sample, smallest first."""
    return df.select(id_col).distinct().join(known.select(id_col), id_col, "left_anti").orderBy(id_col).limit(show)


def unmatched_audit(raw: DataFrame, aligned: DataFrame, id_col: str) -> DataFrame:
    """Rows before and after alignment, and rows that found no partner."""
    flags = raw.join(
        aligned.select(F.col(id_col), F.lit(1).alias("_hit")).dropDuplicates([id_col]), id_col, "left"
    )
    return flags.agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count("_hit").alias("n_aligned"),
        F.count_if(F.col("_hit").isNull()).alias("n_unmatched"),
    )


def align_by_position(frames: list[DataFrame], orders: list[list[str]], out: str = "id") -> DataFrame:
    """Zip tables by their place in an explicit order, down to the shortest one."""
    numbered = [sequential_id(f, o, out) for f, o in zip(frames, orders)]
    return reduce(lambda a, b: a.join(b, out), numbered)


def sample_cells(
    points: DataFrame, raster: DataFrame, *, x: str, y: str, origin: tuple[float, float],
    step: tuple[float, float], row: str = "row", col: str = "col",
) -> DataFrame:
    """Raster values of the cell that holds each point, null outside the raster.

    Cells are unique in the raster, so many points in one cell only repeat its row.
    """
    located = points.withColumn(col, cell(F.col(x), origin[0], step[0])).withColumn(
        row, cell(F.col(y), origin[1], step[1])
    )
    return located.join(raster, [row, col], "left")


def align_nearest(
    target: DataFrame, source: DataFrame, *, target_origin: tuple[float, float],
    target_step: tuple[float, float], source_origin: tuple[float, float],
    source_step: tuple[float, float], values: list[str], row: str = "row", col: str = "col",
) -> DataFrame:
    """Source values at the centres of the target cells (same coordinate system)."""
    x = centre(F.col(col), target_origin[0], target_step[0])
    y = centre(F.col(row), target_origin[1], target_step[1])
    placed = target.withColumn("_c", cell(x, source_origin[0], source_step[0])).withColumn(
        "_r", cell(y, source_origin[1], source_step[1])
    )
    grid = source.select(F.col(row).alias("_r"), F.col(col).alias("_c"), *values)
    return placed.join(grid, ["_r", "_c"], "left").drop("_r", "_c")


def sample_tiles(points: DataFrame, raster: DataFrame, tiles: DataFrame, *, x: str, y: str) -> DataFrame:
    """Raster values ``(tile_id, row, col, ...)`` of the tile cells that hold each point."""
    return points_in_tiles(points, tiles, x=x, y=y).join(raster, ["tile_id", "row", "col"], "left")


def align_tiles(target: DataFrame, target_tiles: DataFrame, sources: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Target cells with the values of one or more source grids at their centres.

    ``sources`` are pairs of raster and tiles, each with value columns of its own; one after
    another is sampled at the centre of every target cell.
    """
    known = target.join(target_tiles.select("tile_id", "x0", "y0", "dx", "dy"), "tile_id")
    x = F.col("x0") + (F.col("col") + F.lit(0.5)) * F.col("dx")
    y = F.col("y0") + (F.col("row") + F.lit(0.5)) * F.col("dy")
    out = known.select(*target.columns, x.alias("_x"), y.alias("_y"))
    for raster, tiles in sources:
        own = {c: f"_own_{c}" for c in ("tile_id", "row", "col")}
        sampled = sample_tiles(out.withColumnsRenamed(own), raster, tiles, x="_x", y="_y").drop("tile_id", "row", "col")
        out = sampled.withColumnsRenamed({v: k for k, v in own.items()})
    return out.drop("_x", "_y")
