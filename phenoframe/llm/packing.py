"""Packing token sequences by cutting-stock column generation.

A document's ids and an end mark are cut into full sequences and one rest. Rests are counted
by size class; column generation on that histogram yields patterns of classes and how often
to use them. Rests are ranked inside their class, and the rank of a rest gives its sequence:
patterns own consecutive ranks of each class they use.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from phenoframe.llm.cutting import solve
from phenoframe.llm.text import map_text, slices, text_bytes
from phenoframe.llm.tokens import SLICE_BYTES, encoder
from phenoframe.scale.bounds import materialised

LENGTH = 2048
END = 1
UNIT = 8  # tokens per step of a size class
SHORT = 64  # rests below so many tokens are bundled first
BUNDLE = 256  # tokens of a bundle at most


def cut_documents(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    length: int = LENGTH,
    end_id: int = END,
    unit: int = UNIT,
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Write the pieces of all documents: ids are made once, in the task that reads the text.

    ``cls`` is a piece's size in units, rounded up, and for sizes below ``SHORT`` the negative of
    the size itself; ``part`` and ``nth`` number the pieces of a class within each task.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = ["start", "length", "ids_crc32", "doc_tokens", "cls", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen = np.zeros(length // unit + 2 + SHORT, np.int64)  # negative classes count from the end
        for batch in batches:
            _, starts = text_bytes(batch.column(1))
            for low, high in slices(starts, SLICE_BYTES):
                owner, rows, kept = [], [], []
                texts = [t or "" for t in batch.column(1)[low:high].to_pylist()]
                for i, ids in enumerate(coder.batch(texts), low):
                    ids += end
                    total = len(ids) // 4
                    for at in range(0, total, length):
                        piece = ids[4 * at : 4 * (at + length)]
                        n = len(piece) // 4
                        cls = -n if n < SHORT and n < length else -(-n // unit)
                        owner.append(i)
                        rows.append((at, n, zlib.crc32(piece), total, cls, part, int(seen[cls])))
                        seen[cls] += 1
                        if with_ids:
                            kept.append(piece)
                table = np.array(rows, np.int64).reshape(-1, len(fields))
                columns = [pa.array(np.ascontiguousarray(table[:, j])) for j in range(len(fields))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), *columns, *([pa.array(kept, pa.binary())] if with_ids else [])],
                    ["doc_id", *fields, *(["ids"] if with_ids else [])],
                )

    schema = f"doc_id {kind}, " + ", ".join(f"{f} bigint" for f in fields) + ", ids binary" * with_ids
    return materialised(map_text(picked, run, schema))


def bundle_rows(demand: dict[int, int], unit: int, length: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """``(short, each, full, whole, base, partial, last)`` per short size; moves its demand.

    ``each`` rests of one size make a bundle, an item of class ``whole`` with ranks from ``base``
    on; the ``full`` bundles come first, what is left is one item of class ``partial`` with rank
    ``last``. Rounding a bundle up to units costs little, rounding each rest would not.
    """
    rows = []
    for cls in sorted(c for c in demand if c < 0):
        n, size = demand.pop(cls), -cls
        each = max(1, min(BUNDLE, length) // size)
        full, left = divmod(n, each)
        whole, partial = -(-each * size // unit), -(-left * size // unit)
        base = demand.get(whole, 0)
        if full:
            demand[whole] = base + full
        last = demand.get(partial, 0)
        if left:
            demand[partial] = last + 1
        rows.append((cls, each, full, whole, base, partial, last))
    return rows


def schedule_rows(demand: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """``(cls, low, high, first, each, slot)``: ranks low..high-1 of a class go to sequences
    from ``first`` on, ``each`` to one, in places from ``slot`` on."""
    full = demand.pop(capacity, 0)
    sizes = np.array(sorted(demand), np.int64)
    counts = np.array([demand[c] for c in sizes.tolist()], np.int64)
    rows, used, sequence = [], np.zeros(len(sizes), np.int64), 0
    for pattern, times in solve(sizes, counts, capacity):
        slot = 0
        for i in np.flatnonzero(pattern)[::-1].tolist():
            each = int(pattern[i])
            low, high = int(used[i]), int(used[i]) + times * each
            rows.append((int(sizes[i]), low, high, sequence, each, slot))
            used[i] = high
            slot += each
        sequence += times
    if full:
        rows.append((capacity, 0, full, sequence, 1, 0))
    return rows


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END,
    unit: int = UNIT,
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` per piece.

    ``start`` counts the document's ids before the piece and ``offset`` the ids before it in
    its sequence; ``with_ids`` adds the ids as little-endian 32-bit integers. Null and empty
    texts are documents of the end mark alone; repeated rows are packed each for itself; an
    empty table has no pieces. ``length`` must be a multiple of ``unit``.

    The driver gets one count per class (at most ``length / unit``). The schedule has a row
    per pattern and class in it; patterns are no more than classes plus what rounding leaves,
    so it is broadcast whatever the number of documents.
    """
    spark = docs.sparkSession
    pieces = cut_documents(docs, id_col, text_col, length, end_id, unit, tokenizer, with_ids)
    counts = pieces.groupBy("cls", "part").agg(F.count(F.lit(1)).alias("n"))
    demand = {r["cls"]: r["n"] for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialised(
        counts.select(
            F.col("cls").alias("_cls"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
        )
    )
    bundles = spark.createDataFrame(
        bundle_rows(demand, unit, length), "b_cls bigint, b_each bigint, b_full bigint, whole bigint, b_base bigint, partial bigint, last bigint"
    )
    names = ["s_cls", "low", "high", "first", "each", "slot"]
    schedule = spark.createDataFrame(
        schedule_rows(demand, length // unit), ", ".join(f"{c} bigint" for c in names)
    )
    ranked = (
        pieces.join(starts, (pieces["cls"] == starts["_cls"]) & (pieces["part"] == starts["_part"]))
        .withColumn("nth_of", F.col("base") + F.col("nth"))
        .join(F.broadcast(bundles), F.col("cls") == F.col("b_cls"), "left")
    )
    bundle = F.expr("nth_of div b_each")
    ranked = ranked.select(
        *pieces.columns,
        F.when(F.col("b_cls").isNull(), F.col("cls")).when(bundle < F.col("b_full"), F.col("whole")).otherwise(F.col("partial")).alias("item"),
        F.when(F.col("b_cls").isNull(), F.col("nth_of")).when(bundle < F.col("b_full"), F.col("b_base") + bundle).otherwise(F.col("last")).alias("rank"),
        F.when(F.col("b_cls").isNull(), F.lit(0)).otherwise(F.col("nth_of") % F.col("b_each")).alias("inner"),
    )
    inside = F.col("rank") - F.col("low")
    placed = ranked.join(
        F.broadcast(schedule), (F.col("item") == F.col("s_cls")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    ).select(
        *pieces.columns,
        (F.col("first") + F.expr("(rank - low) div each")).alias("sequence_id"),
        (F.col("slot") + inside % F.col("each")).alias("place"),
        "inner",
    )
    ahead = Window.partitionBy("sequence_id").orderBy("place", "inner").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"),
        *(["ids"] if with_ids else []),
    )
