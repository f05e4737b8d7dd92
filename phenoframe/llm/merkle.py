"""A manifest of a dataset as a hash tree, with a witness for every row.

Rows are leaves of a tree per source, whose roots are the leaves of one tree above. Leaves are
appended in order to aligned blocks. Within a block each leaf carries a partial witness: when
the run that a finished subtree belongs to is complete, the digests beside it are added to the
witnesses of all leaves below. Roots of blocks are then appended to the next tree in the same
way, and what their witnesses gain extends those of their leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.llm.places import attach, numbered
from phenoframe.scale.bounds import materialised

ARITY = 3
HEIGHT = 7  # levels of a block
WITNESS = "array<struct<before:string,after:string>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Witnesses:
    """Appends digests to one block and extends the witnesses of what is below.

    A subtree is ``(digest, low, high)``, ``low:high`` its leaves. ``open`` holds, per level,
    the subtrees whose run is not complete.
    """

    def __init__(self, arity: int = ARITY):
        self.arity, self.open, self.witnesses = arity, [[]], []

    def append(self, leaf: str) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self.open[0].append((leaf, at, at + 1))
        level = 0
        while len(self.open[level]) == self.arity:
            self._complete(level)
            level += 1

    def _complete(self, level: int) -> None:
        run = self.open[level]
        names = [subtree[0] for subtree in run]
        for i, (_, low, high) in enumerate(run):
            beside = {"before": "".join(names[:i]), "after": "".join(names[i + 1 :])}
            for witness in self.witnesses[low:high]:
                witness.append(beside)
        self.open[level] = []
        if len(self.open) == level + 1:
            self.open.append([])
        self.open[level + 1].append((digest(names), run[0][1], run[-1][2]))

    def finish(self, height: int | None) -> str:
        """Close the open runs, up to ``height`` levels or until one subtree is left."""
        level = 0
        while level < height if height is not None else len(self.open[level]) > 1 or any(self.open[level + 1 :]):
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


def grow(nodes: DataFrame, height: int, arity: int) -> DataFrame:
    """Append the nodes ``(tree, at, total, digest, ...)`` to the blocks of their trees.

    Adds ``block``, the ``witness`` within it and, to the first node of a block, its ``root``. A
    task streams over its blocks of ``arity ** height`` nodes and holds one at a time.
    """
    width = arity**height
    beside = pa.list_(pa.struct({"before": pa.string(), "after": pa.string()}))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, pieces = None, Witnesses(arity), []

        def closed() -> Iterator[pa.RecordBatch]:
            if pieces:
                whole = pa.Table.from_batches(pieces)
                root = tree.finish(height if whole["total"][0].as_py() > width else None)
                whole = whole.append_column("witness", pa.array(tree.witnesses, beside))
                roots = [root] + [None] * (whole.num_rows - 1)
                yield from whole.append_column("root", pa.array(roots, pa.string())).to_batches()

        for batch in batches:
            keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist()))
            digests, low = batch.column("digest").to_pylist(), 0
            for at, (here, leaf) in enumerate(zip(keys, digests)):
                if here != key:
                    if at > low:
                        pieces.append(batch.slice(low, at - low))
                    yield from closed()
                    key, tree, pieces, low = here, Witnesses(arity), [], at
                tree.append(leaf)
            if batch.num_rows > low:
                pieces.append(batch.slice(low))
        yield from closed()

    block = F.floor(F.col("at") / F.lit(width)).cast("bigint")
    dealt = nodes.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(task, f"{kinds}, witness {WITNESS}, root string")


def climb(nodes: DataFrame, height: int = HEIGHT, arity: int = ARITY) -> tuple[DataFrame, DataFrame]:
    """Append nodes to blocks, the roots of those to blocks again, up to one root per tree.

    Returns the grown nodes and, per ``(tree, block)``, what extends their witnesses (``beyond``)
    and the tree's root (``subroot``). A round leaves one row per block; the rounds are as many
    as the largest tree has levels of blocks.
    """
    width = arity**height
    grown = materialised(grow(nodes, height, arity))
    tops = grown.where(F.col("root").isNotNull()).select("tree", "block", "total", "root")
    done = tops.where(F.col("total") <= width).select(
        "tree", "block", F.array().cast(WITNESS).alias("beyond"), F.col("root").alias("subroot")
    )
    more = tops.where(F.col("total") > width)
    if more.isEmpty():
        return grown, done
    blocks = F.ceil(F.col("total") / F.lit(width)).cast("bigint")
    above = more.select("tree", F.col("block").alias("at"), blocks.alias("total"), F.col("root").alias("digest"))
    higher, ends = climb(above, height, arity)
    longer = higher.join(ends, ["tree", "block"]).select(
        "tree", F.col("at").alias("block"), F.concat("witness", "beyond").alias("beyond"), "subroot"
    )
    return grown, done.unionByName(longer)


def field(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(
        witness, leaf, lambda node, beside: F.sha2(F.concat(beside["before"], node, beside["after"]).cast("binary"), 256)
    )


def dataset_manifest(
    docs: DataFrame,
    fields: list[str],
    id_col: str,
    source_col: str,
    found: dict[str, Column] | None = None,
    height: int = HEIGHT,
) -> DataFrame:
    """Every row's id, ``leaf``, ``subroot``, ``root``, ``witness`` and ``claim``.

    A leaf is the digest of ``fields``; ``claim`` is that of the same fields where ``found`` gives
    other values for some of them, as a later reader of the data has them. Leaves of a source are in
    order of id (null first) and, for repeated ids, of their digests; sources are in order of
    their bytes, null first. Null and empty values differ. A table without rows gives none. Other
    columns are ignored; texts are hashed where they are read and never move.
    """
    now = found or {}
    named = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(source_col)), F.lit("")).alias("tree"),
        F.col(id_col).alias("id"),
        leaf_digest([F.col(c) for c in fields]).alias("digest"),
        leaf_digest([now.get(c, F.col(c)) for c in fields]).alias("claim"),
    )
    rank = [F.col("_at").alias("at"), F.col("_total").alias("total")]
    leaves = numbered(materialised(named), ["tree"], ["id", "digest"]).select("tree", *rank, "digest", "id", "claim")
    grown, ends = climb(leaves, height)
    ends = materialised(ends)
    trees = materialised(ends.groupBy("tree").agg(F.first("subroot").alias("digest"), F.count(F.lit(1)).alias("blocks")))
    above = numbered(trees.select(F.lit("").alias("top"), "tree", "digest"), ["top"], ["tree"])
    upper, tops = climb(above.select(F.col("top").alias("tree"), *rank, "digest", F.col("tree").alias("name")), height)
    roots = upper.join(tops.withColumnRenamed("subroot", "top_root"), ["tree", "block"]).select(
        F.col("name").alias("tree"), F.concat("witness", "beyond").alias("upper"), F.col("top_root")
    )
    roots = materialised(roots.join(trees.select("tree", "blocks"), "tree"))
    ends = attach(ends, roots, ["tree"], "blocks")
    return grown.drop("root").join(ends, ["tree", "block"]).select(
        F.col("id").alias(id_col),
        F.col("digest").alias("leaf"),
        "claim",
        "subroot",
        F.col("top_root").alias("root"),
        F.concat("witness", "beyond", "upper").alias("witness"),
    )


def proof_text(witness: Column) -> Column:
    """The digests of a witness, level by level, left to right."""
    return F.array_join(F.transform(witness, lambda s: F.concat(s["before"], s["after"])), "")
