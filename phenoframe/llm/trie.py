"""The prefix trie of conversations by fixed-length blocks of turns.

A turn is known by a digest, a prefix by the exclusive or of the hashes of its turns with their
places. Conversations are grouped by the prefixes that end at block borders first. A block whose
parent has no other block below holds the same conversations at each of its turns; only blocks
with siblings are taken apart by turn and grouped again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoframe.llm.places import attach, runs
from phenoframe.scale.bounds import materialised

BLOCK = 4  # turns
SPAN = 1024  # blocks whose prefixes one window covers
CHUNK_BITS = 12  # ids of a node's ends that meet in one row
WORDS = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "x1", "x2"]


def turns_of(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv_id, turn, digest, words)``; texts are read once and never move.

    Null roles and texts are empty. Rows without a conversation id belong to none and are left out.
    Turns with the same number are in order of their digests; repeated rows all count.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    name = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.md5(name.cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("words"),
    )


def plain(turns: DataFrame) -> DataFrame:
    """Conversations as they are: ``(conv_id, size, pos, digest, words)``, ``pos`` from 1."""
    table, starts = runs(turns, ["conv_id"], ["turn", "digest"])
    at = F.col("_before") + F.col("_m") - F.col("_first") + 1
    return table.join(starts, ["conv_id", "_part"]).select(
        "conv_id", F.col("_total").alias("size"), at.alias("pos"), "digest", "words"
    )


def rebuilt(turns: DataFrame, family: Column, taken: Column, most: int) -> DataFrame:
    """Conversations that start with turns of another one.

    ``family`` names, per ``conv_id``, the conversation that lends its first ``taken`` turns (at
    most ``most``, all if it has fewer, none if it does not exist); the own turns after the
    first ``taken`` follow. A conversation without turns left has one row with ``pos`` null.
    The borrowers of one conversation meet at one key, so they should be boundedly many.
    """
    table, starts = runs(turns, ["conv_id"], ["turn", "digest"])
    at = F.col("_before") + F.col("_m") - F.col("_first")
    convs = starts.groupBy("conv_id").agg(F.first("_total").alias("own"))
    convs = convs.select("conv_id", "own", family.alias("family"), taken.cast("bigint").alias("taken"))
    lenders = convs.select(F.col("family").alias("conv_id")).distinct()
    first = table.join(starts.where(F.col("_before") < most), ["conv_id", "_part"]).where(at < most)
    first = first.join(lenders, "conv_id", "left_semi")
    heads = first.groupBy(F.col("conv_id").alias("family")).agg(
        F.array_sort(F.collect_list(F.struct(at.alias("at"), "digest", "words"))).alias("head")
    )
    lent = F.coalesce(F.slice("head", F.lit(1), F.col("taken").cast("int")), F.array().cast("array<struct<at:bigint,digest:string,words:bigint>>"))
    convs = convs.join(heads, "family", "left").withColumn("head", lent)
    size = F.size("head") + F.greatest(F.col("own") - F.col("taken"), F.lit(0))
    convs = materialised(convs.withColumn("size", size.cast("bigint")))
    moved = materialised(starts.join(convs.select("conv_id", "size", "taken", F.size("head").alias("lent")), "conv_id"))
    own = (
        table.join(moved, ["conv_id", "_part"])
        .where(at >= F.col("taken"))
        .select("conv_id", "size", (at - F.col("taken") + F.col("lent") + 1).cast("bigint").alias("pos"), "digest", "words")
    )
    lent = convs.select("conv_id", "size", F.explode("head").alias("h")).select(
        "conv_id", "size", (F.col("h.at") + 1).cast("bigint").alias("pos"), "h.digest", "h.words"
    )
    bare = convs.where("size = 0").select(
        "conv_id", "size", F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("bigint").alias("words")
    )
    return own.unionByName(lent).unionByName(bare)


def blocks_of(rows: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """One row per conversation and block: its turns, and the prefix before and after it.

    Prefixes are running totals over spans of blocks, and over the totals of spans, so that a
    long conversation is spread like many short ones.
    """
    place = F.col("pos")
    hashed = rows.where("pos is not null").select(
        "conv_id",
        "size",
        F.floor((place - 1) / F.lit(block)).cast("bigint").alias("j"),
        F.struct("pos", F.xxhash64(F.lit(1), place, "digest").alias("x1"), F.xxhash64(F.lit(2), place, "digest").alias("x2"), "words").alias("turn"),
    )
    totals = [F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("words").alias("words")]
    cut = hashed.groupBy("conv_id", "j").agg(
        F.first("size").alias("size"),
        F.array_sort(F.collect_list("turn")).alias("turns"),
        F.bit_xor("turn.x1").alias("x1"),
        F.bit_xor("turn.x2").alias("x2"),
        F.sum("turn.words").alias("words"),
    )
    cut = materialised(cut.withColumn("span", F.floor(F.col("j") / F.lit(span)).cast("bigint")))
    inside = Window.partitionBy("conv_id", "span").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut.groupBy("conv_id", "span").agg(*totals)

    def before(window, name: str) -> Column:
        total = F.sum(name) if name == "words" else F.bit_xor(name)
        return F.coalesce(total.over(window), F.lit(0))

    names = ["x1", "x2", "words"]
    spans = spans.select("conv_id", "span", *[before(over, n).alias(f"s_{n}") for n in names])
    joined = cut.select("*", *[before(inside, n).alias(f"b_{n}") for n in names]).join(spans, ["conv_id", "span"])
    p1, p2 = (F.col(f"b_{n}").bitwiseXOR(F.col(f"s_{n}")) for n in ("x1", "x2"))
    return joined.select(
        "conv_id",
        "size",
        "j",
        "turns",
        p1.alias("p1"),
        p2.alias("p2"),
        p1.bitwiseXOR(F.col("x1")).alias("a1"),
        p2.bitwiseXOR(F.col("x2")).alias("a2"),
        (F.col("b_words") + F.col("s_words")).alias("before"),
        "words",
    )


STATE = ["j", "t", "a1", "a2"]


def nodes_of(states: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Nodes of the turns in the blocks ``states``, which say whether they have ``siblings``.

    ``sums`` names the columns to carry over and how siblings that share a turn combine them.
    """
    value = lambda name: F.aggregate(
        F.slice("turns", F.lit(1), F.col("i") + 1), F.lit(0).cast("bigint"), lambda s, t: s.bitwiseXOR(t[name])
    )
    turns = states.select("*", F.posexplode("turns").alias("i", "turn"))
    turns = turns.withColumn("x1", F.col("p1").bitwiseXOR(value("x1"))).withColumn("x2", F.col("p2").bitwiseXOR(value("x2")))
    passed = F.aggregate(F.slice("turns", F.lit(1), F.col("i")), F.lit(0).cast("bigint"), lambda s, t: s + t["words"])
    turns = turns.select(
        "siblings",
        F.col("turn.pos").alias("depth"),
        "x1",
        "x2",
        F.col("x1").bitwiseXOR(F.col("turn.x1")).alias("y1"),
        F.col("x2").bitwiseXOR(F.col("turn.x2")).alias("y2"),
        F.col("turn.words").alias("words"),
        (F.col("before") + passed).alias("before"),
        *sums,
    )
    same = ["y1", "y2", "words", "before"]
    alone = turns.where("siblings = 1").select(*NODE, *same, *sums)
    merged = turns.where("siblings > 1").groupBy(*NODE).agg(
        *[F.first(c).alias(c) for c in same], *[getattr(F, how)(c).alias(c) for c, how in sums.items()]
    )
    return alone.unionByName(merged)


def id_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of each node's ends ``(depth, x1, x2, conv_id)``.

    Ids meet in rows of at most 4,096 neighbours first; a task streams over those rows.
    """
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    rows = ends.groupBy(*NODE, chunk.alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    rows = rows.select(*NODE, "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list[tuple], found: list[str]) -> pa.RecordBatch:
            columns = [*map(list, zip(*keys)), found] if keys else [[], [], [], []]
            kinds = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*NODE, "ends_sha256"])

        open_, state = None, None
        for batch in batches:
            keys, found = [], []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if key != open_:
                    if state is not None:
                        keys.append(open_)
                        found.append(state.hexdigest())
                    open_, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield out(keys, found)
        if state is not None:
            yield out([open_], [state.hexdigest()])

    dealt = rows.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return dealt.mapInArrow(task, "depth bigint, x1 bigint, x2 bigint, ends_sha256 string")


def prefix_trie(rows: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """One row per node of the trie of ``rows`` (``conv_id, size, pos, digest, words``).

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. Conversations without turns
    (one row, ``pos`` null) are members of the root. Without conversations there are no nodes.

    What a subtree saves follows from its members: a conversation saves the words of the turns
    at which it is not the smallest member. Those are its first turns, up to where it parts from
    all smaller ones, so no walk over the tree is needed.
    """
    rows = materialised(rows)
    blocks = materialised(blocks_of(rows, block, span))
    keyed = blocks.withColumn("t", F.size("turns"))
    content = [F.first(c).alias(c) for c in ("turns", "p1", "p2", "before")]
    states = materialised(
        keyed.groupBy(*STATE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *content)
    )
    siblings = materialised(states.groupBy("j", "p1", "p2").agg(F.count(F.lit(1)).alias("siblings")))
    states = materialised(attach(states, siblings.withColumn("_rows", F.col("siblings")), ["j", "p1", "p2"], "_rows"))
    nodes = materialised(nodes_of(states, {"n_convs": "sum", "conv_id": "min"}))

    parent = [(F.col("depth") - 1).alias("depth"), F.col("y1").alias("x1"), F.col("y2").alias("x2")]
    children = materialised(nodes.select(*parent).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children")))
    parted = (
        nodes.join(children, NODE, "left")
        .groupBy("conv_id")
        .agg(F.min("before").alias("parted"), F.max(F.col("n_children").isNull().cast("bigint")).alias("leaf"))
    )
    convs = rows.groupBy("conv_id").agg(F.first("size").alias("size"), F.sum("words").alias("words"), F.count("pos").alias("turns"))
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.max("size").alias("longest")).first()
    if not root["n"]:
        return rows.sparkSession.createDataFrame([], TRIE)
    least = F.col("conv_id") == F.lit(root["least"])
    shared = F.when(least, 0).otherwise(F.coalesce("parted", "words")).cast("bigint")
    found = materialised(
        convs.join(parted, "conv_id", "left").select(
            "conv_id", "size", shared.alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.ceil(F.col("turns") / F.lit(block)).alias("_rows")
        )
    )
    members = attach(
        materialised(keyed.select("conv_id", *STATE)), found.where("size > 0").drop("size"), ["conv_id"], "_rows"
    )
    sums = members.groupBy(*STATE).agg(
        F.sum("shared").alias("shared"), F.min("shared").alias("least"), F.sum("leaf").alias("n_leaves")
    )
    combined = {"n_convs": "sum", "conv_id": "min", "shared": "sum", "least": "min", "n_leaves": "sum"}
    full = nodes_of(states.join(sums, STATE), combined)
    top = found.agg(
        F.lit(0).cast("bigint").alias("depth"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("x1", "x2", "words", "before")],
        *[F.lit(None).cast("bigint").alias(c) for c in ("y1", "y2")],
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.sum("shared").alias("shared"),
        F.lit(0).cast("bigint").alias("least"),
        F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"),
    )
    saved = F.col("shared") - F.col("least") - (F.col("n_convs") - 1) * F.col("before")
    last = keyed.where(F.col("j") == F.floor((F.col("size") - 1) / F.lit(block)))
    ends = last.select(F.col("size").alias("depth"), F.col("a1").alias("x1"), F.col("a2").alias("x2"), "conv_id")
    bare = rows.where("pos is null").select(*[F.lit(0).cast("bigint").alias(c) for c in NODE], "conv_id")
    every = (
        full.unionByName(top)
        .join(children, NODE, "left")
        .join(id_digests(ends.unionByName(bare)), NODE, "left")
        .select(
            *NODE,
            "y1",
            "y2",
            "conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            F.col("n_leaves").cast("bigint").alias("n_leaves"),
            saved.cast("bigint").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )
    every = materialised(every)
    above = every.where("n_children > 0").select(
        F.col("depth").alias("above"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_rows")
    )
    placed = attach(every.withColumn("above", F.col("depth") - 1), above, ["above", "y1", "y2"], "_rows")
    return placed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


TRIE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
