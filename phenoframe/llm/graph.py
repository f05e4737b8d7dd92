"""Connected components by contraction in random order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenoframe.scale.bounds import materialised


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, label)`` for every node of an edge table; nodes of a component share a label.

    Each round draws a new random order, every node joins its first neighbour in that order,
    and edges are rewritten between the joined nodes. A constant share of nodes goes per
    round, also on long paths, so the rounds are logarithmic. Minima are combined before
    their shuffle; hub nodes meet only in joins of written tables, which Spark can split.
    Rounds are written to the shared folder. Edges with a null end and loops are ignored.
    """
    known = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    live = materialised(
        edges.where(known).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    )
    labels, turn = None, 0
    while True:
        turn += 1
        rank = lambda x: F.struct(F.xxhash64(F.lit(turn), x).alias("h"), x.alias("x"))
        both = live.select(F.col("u").alias("node"), F.col("v").alias("other")).union(
            live.select("v", "u")
        )
        first = both.groupBy("node").agg(F.min(rank(F.col("other"))).alias("m"))
        step = materialised(
            first.select("node", F.least("m", rank(F.col("node"))).getField("x").alias("parent"))
        )
        labels = step.select("node", F.col("parent").alias("label")) if labels is None else labels.join(
            step, labels["label"] == step["node"], "left"
        ).select(labels["node"], F.coalesce("parent", "label").alias("label"))
        of_u, of_v = (
            step.select(F.col("node").alias(f"_{x}"), F.col("parent").alias(f"p{x}")) for x in "uv"
        )
        live = materialised(
            live.join(of_u, live["u"] == of_u["_u"])
            .join(of_v, F.col("v") == of_v["_v"])
            .where("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct()
        )
        if live.isEmpty():
            return materialised(labels)
