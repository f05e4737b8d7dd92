"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors collapse to one node. The nodes of a label are clustered; a cluster is a shard,
and each node also visits near shards whose border lies within the link radius. Of two shards
only one sends visitors to the other, so linked nodes of different shards meet once, where one
of them is at home, and the link counts for both. A node visits the nearest few such shards; how
many, an audit of links decides per label, up to all of them, which loses no link. A shard
that outgrows ``shard_rows`` is dealt into parts, and its
queries visit all of them, at most about ``shard_rows`` in one task. Each part builds a graph whose edges are pruned for direction
(a far neighbour is dropped when a nearer one leads to it), the adjacency lists of a node from
all its shards are united, and each node searches its home shard: a greedy beam from its own
place and a few spread nodes, then everything in range is expanded until nothing new is in
range. Similarities are double precision throughout. In every part a hash-chosen sample of
queries is compared with all nodes; where the mean recall per query is too low, for queries
with few links or with many, from the part or from others, the part is scanned exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoframe.llm.graph import components
from phenoframe.llm.simhash import joined_labels
from phenoframe.llm.text import mix
from phenoframe.scale.bounds import materialised

SIMILARITY = 0.93
SHARD_ROWS = 4096  # nodes a centroid is meant for, and in one part of a shard
CENTROIDS = 8192  # at most, over all labels; larger shards are dealt into parts
SAMPLE_ROWS = 40_000  # vectors that place the centroids, at most
NEAR_SHARDS = 6  # nearest shards, its home included, that a node can be in; doubled where links get lost
CANDIDATES, DEGREE, ALPHA = 48, 24, 1.2
BEAM = 48
SLACK = 0.06  # nodes this much below the similarity are still expanded
ENTRIES = 8  # nodes of a part, far from each other, where each search starts
AUDITED = 256  # queries per part, its own and as many of other parts
RECALL = 0.97  # mean over audited queries; below, a part is scanned exactly
CELLS = 1 << 20  # entries of a block's query x node table
SHARD_CELLS = 1 << 17  # entries of a block's row x centroid table, and rows it can give


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_candidates(x: np.ndarray) -> np.ndarray:
    """Nearest nodes of each node and a few spread ones, own number for missing places."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    out = np.empty((n, k), np.int64)
    for low in range(0, n, 512):
        s = x[low : low + 512] @ x.T
        s[np.arange(len(s)), np.arange(low, low + len(s))] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[low : low + 512] = top
    far = np.random.default_rng(n).integers(0, n, (n, 16))
    return np.concatenate([out, far], axis=1)


def robust_prune(x: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Up to ``DEGREE`` neighbours per node; -1 fills the rest."""
    n = len(x)
    kept = np.full((n, DEGREE), -1, np.int64)
    for low in range(0, n, 256):
        rows = np.arange(low, min(n, low + 256))
        c = candidates[rows]
        v = x[c]
        d = np.sqrt(np.maximum(2 - 2 * np.einsum("qd,qkd->qk", x[rows], v), 0))
        d[c == rows[:, None]] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        v = x[c]
        between = np.sqrt(np.maximum(2 - 2 * v @ v.transpose(0, 2, 1), 0))
        open_, count = np.isfinite(d), np.zeros(len(rows), np.int64)
        for j in range(c.shape[1]):
            take = np.flatnonzero(open_[:, j] & (count < DEGREE))
            kept[rows[take], count[take]] = c[take, j]
            count[take] += 1
            open_[take] &= ~(ALPHA * between[take, j] <= d[take])
    return kept


def shard_graph(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each node: pruned edges and their reverse."""
    if len(x) < 2:
        return [np.empty(0, np.int64) for _ in range(len(x))]
    kept = robust_prune(x, near_candidates(x))
    source = np.repeat(np.arange(len(x)), kept.shape[1])[kept.ravel() >= 0]
    target = kept.ravel()[kept.ravel() >= 0]
    pairs = np.unique(np.concatenate([source * len(x) + target, target * len(x) + source]))
    return np.split(pairs % len(x), np.searchsorted(pairs // len(x), np.arange(1, len(x))))


class Searcher:
    """Range search over one part's nodes and united adjacency lists."""

    def __init__(self, x: np.ndarray, begin: np.ndarray, target: np.ndarray, similarity: float, beam: int):
        self.x, self.begin, self.target = x, begin, target
        self.similarity, self.beam = similarity, beam
        entries = [int((x @ x.mean(axis=0)).argmax())]
        nearest = x @ x[entries[0]]
        while len(entries) < min(ENTRIES, len(x)):
            entries.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, x @ x[entries[-1]])
        self.entries = np.unique(entries)

    def visit(self, s: np.ndarray, asked: np.ndarray, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Similarities of unseen neighbours of (query, node) pairs go to ``s``; their cells."""
        size = self.begin[node + 1] - self.begin[node]
        at = np.repeat(self.begin[node] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        cell = np.repeat(q, size) * s.shape[1] + self.target[at]
        cell = np.unique(cell[s.ravel()[cell] == -2])
        for low in range(0, len(cell), 1 << 16):
            c = cell[low : low + (1 << 16)]
            s.ravel()[c] = np.einsum("nd,nd->n", asked[c // s.shape[1]], self.x[c % s.shape[1]])
        return cell

    def run(self, asked: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and node of everything found in range; ``own`` has the queries' nodes or -1."""
        n, rows = len(self.x), len(asked)
        s = np.full((rows, n), -2.0)
        s[:, self.entries] = asked @ self.x[self.entries].T
        mine = np.flatnonzero(own >= 0)
        s[mine, own[mine]] = np.einsum("nd,nd->n", asked[mine], self.x[own[mine]])
        expanded = np.zeros((rows, n), bool)
        width = min(self.beam, n)
        pool = np.zeros((rows, max(width, len(self.entries) + 1)), np.int64)  # the beam: best nodes seen so far
        worth = np.full(pool.shape, -3.0)
        pool[:, 1 : len(self.entries) + 1] = self.entries
        worth[:, 1 : len(self.entries) + 1] = np.where(self.entries == own[:, None], -3, s[:, self.entries])
        pool[mine, 0], worth[mine, 0] = own[mine], s[mine, own[mine]]
        every, steps = np.arange(rows)[:, None], min(4, width)
        while True:  # the best open nodes of each beam are expanded
            value = np.where(expanded[every, pool], -3, worth)
            best = np.argpartition(-value, steps - 1, axis=1)[:, :steps]
            q, at = np.nonzero(np.take_along_axis(value, best, 1) > -3)
            if not len(q):
                break
            node = pool[q, best[q, at]]
            expanded[q, node] = True
            cell = self.visit(s, asked, q, node)
            if not len(cell):
                continue
            first = np.searchsorted(cell, np.arange(rows + 1) * n)
            place = np.arange(len(cell)) - first[cell // n]
            more = np.zeros((rows, int(place.max()) + 1), np.int64)
            gain = np.full(more.shape, -3.0)
            more[cell // n, place], gain[cell // n, place] = cell % n, s.ravel()[cell]
            pool, worth = np.concatenate([pool, more], axis=1), np.concatenate([worth, gain], axis=1)
            top = np.argpartition(-worth, width - 1, axis=1)[:, :width]
            pool, worth = np.take_along_axis(pool, top, 1), np.take_along_axis(worth, top, 1)
        q, node = np.nonzero((s >= self.similarity - SLACK) & ~expanded)
        while len(q):  # the range grows from what was found
            expanded[q, node] = True
            new = self.visit(s, asked, q, node)
            new = new[s.ravel()[new] >= self.similarity - SLACK]
            q, node = new // n, new % n
        return np.nonzero(s >= self.similarity)

    def links(self, block: np.ndarray, every: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """Query and node of the links of a block of rows of ``every``, whose first are the nodes."""
        if exact:
            q, node = np.nonzero(every[block] @ self.x.T >= self.similarity)
        else:
            q, node = self.run(every[block], np.where(block < len(self.x), block, -1))
        other = block[q] != node
        return q[other], node[other]

    def falls_short(self, asked: np.ndarray, every: np.ndarray, step: int) -> bool:
        """Whether audited queries, among the first of ``asked``, find too little.

        Recall is averaged per query, and apart for own and foreign queries with few and with
        many links, so that no large group hides what the rest loses.
        """
        n = len(self.x)
        if n <= AUDITED:
            return True  # the audit would compare all of it
        some = np.concatenate([asked[asked < n][:AUDITED], asked[asked >= n][:AUDITED]])
        found, due = np.zeros(len(some)), np.zeros(len(some))
        for low in range(0, len(some), step):
            block = some[low : low + step]
            for count, exact in ((found, False), (due, True)):
                count[low : low + step] = np.bincount(self.links(block, every, exact)[0], minlength=len(block))
        for own in (some < n, some >= n):
            for few in (due <= DEGREE, due > DEGREE):
                kind = own & few & (due > 0)
                if kind.any() and (found[kind] / due[kind]).mean() < RECALL:
                    return True
        return False


def visits(a, b):
    """Whether nodes at home in shard ``a`` visit shard ``b``; of two shards one visits the other."""
    return ((a + b) % 2 == 0) == (a < b)


def near_shards(
    x: np.ndarray, c: np.ndarray, similarity: float, most: int | None = None, oneway: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, shard and whether it is the home, of the shards each row of ``x`` belongs to.

    These are the shards whose border is within the link radius; with ``most`` those among its
    nearest, with ``oneway`` those that the home's nodes visit. Rows come in blocks whose
    tables hold at most ``SHARD_CELLS`` entries.
    """
    reach = 2 * float(np.sqrt(max(0.0, 2 - 2 * similarity)))
    square = (c * c).sum(axis=1)
    step = max(1, SHARD_CELLS // len(c))
    for low in range(0, len(x), step):
        rows = x[low : low + step]
        d = square[None, :] - 2 * rows @ c.T
        first = d.argmin(axis=1)
        gap = square[first][:, None] + square[None, :] - 2 * c[first] @ c.T
        gap = np.sqrt(np.maximum(gap, 0) + 1e-12)  # never below the true distance
        inside = d - d[np.arange(len(rows)), first][:, None] <= reach * gap + 1e-9
        if most is not None and most < len(c):
            inside &= d <= np.partition(d, most - 1, axis=1)[:, most - 1 : most]
        if oneway:
            inside &= visits(first[:, None], np.arange(len(c))[None, :]) | (np.arange(len(c)) == first[:, None])
        i, j = np.nonzero(inside)
        yield low + i, j, j == first[i]


def shard_ranks(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rank of each centroid by its distance from each row; a row's home has rank 0."""
    d = (c * c).sum(axis=1)[None, :] - 2 * x @ c.T
    ranks = np.empty(d.shape, np.int32)
    np.put_along_axis(ranks, np.argsort(d, axis=1, kind="stable"), np.arange(len(c), dtype=np.int32)[None, :], axis=1)
    return ranks


def levels(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How often ``NEAR_SHARDS`` must double before rows ``i`` and ``j`` meet, by their tables of ranks."""
    a, b = x.argmin(axis=1)[i], y.argmin(axis=1)[j]
    rank = np.where(visits(a, b), x[i, b], y[j, a])  # 0 where both are at home
    return np.ceil(np.log2(np.maximum(1, (rank + 1) / NEAR_SHARDS))).astype(np.int64)


def simulated_levels(x: np.ndarray, ranks: np.ndarray, c: np.ndarray, similarity: float) -> np.ndarray:
    """Levels of links to made-up vectors, in any direction at any cosine down to the link's."""
    rng = np.random.default_rng(len(x))
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
    cosine = rng.uniform(similarity, 1, (len(x), 1))
    moved = cosine * x + np.sqrt(np.maximum(0, 1 - cosine**2)) * aside
    every = np.arange(len(x))
    return levels(ranks, shard_ranks(moved, c), every, every)


def shards_needed(nodes: DataFrame, centroids: dict, sample: dict, similarity: float) -> dict[int, int]:
    """Nearest shards per group that keep ``RECALL`` of the links; groups not named need all.

    The sampled nodes of a group, at most ``AUDITED``, are compared with all its nodes. Recall
    is the mean, over sampled nodes with links, of the share whose two ends meet in a shard.
    Made-up links must reach it too, since a group's sample may have few links or none. Groups
    with at most ``NEAR_SHARDS`` shards are not audited: they lose nothing.
    """
    asked = {
        g: (sample[g][0], sample[g][1], shard_ranks(sample[g][1], c))
        for g, c in centroids.items()
        if len(c) > NEAR_SHARDS
    }
    if not asked:
        return {}
    sent = nodes.sparkSession.sparkContext.broadcast(({g: centroids[g] for g in asked}, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("grp").to_numpy(zero_copy_only=False)
            ids = batch.column("node").to_numpy(zero_copy_only=False)
            for g in np.unique(groups).tolist():
                if g not in sent.value[1]:
                    continue
                c, (names, x, ranks) = sent.value[0][g], sent.value[1][g]
                rows = np.flatnonzero(groups == g)
                y = matrix(batch.column("embedding").take(pa.array(rows)))
                step, counts = max(1, SHARD_CELLS // len(c)), np.zeros((len(x), 64), np.int64)
                for low in range(0, len(y), step):
                    some = y[low : low + step]
                    j, i = np.nonzero((some @ x.T >= similarity) & (ids[rows[low : low + step], None] != names))
                    if len(i):
                        np.add.at(counts, (i, levels(ranks, shard_ranks(some, c), i, j)), 1)
                i, level = np.nonzero(counts)
                columns = [np.full(len(i), g), names[i], level, counts[i, level]]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in columns], ["grp", "node", "level", "n"])

    audited = nodes.select("node", "grp", "embedding").mapInArrow(run, "grp bigint, node bigint, level bigint, n bigint")
    found = audited.groupBy("grp", "node", "level").agg(F.sum("n").alias("n")).toPandas()
    found["share"] = found["n"] / found.groupby(["grp", "node"])["n"].transform("sum")
    needed = {}
    for g, (_, x, ranks) in asked.items():
        made = simulated_levels(x, ranks, centroids[g], similarity)
        real = found[found["grp"] == g]
        queries = max(1, real["node"].nunique())
        level = 0
        while NEAR_SHARDS << level < len(centroids[g]):
            kept = real.loc[real["level"] <= level, "share"].sum() / queries if len(real) else 1.0
            if min(kept, (made <= level).mean()) >= RECALL:
                needed[g] = NEAR_SHARDS << level
                break
            level += 1
    return needed


def assigned(nodes: DataFrame, centroids: dict, similarity: float, most: dict[int, int] | None = None) -> DataFrame:
    """A row per node and shard it belongs to; ``home`` marks the nearest centroid's shard.

    ``most`` bounds the shards of a node for the groups it names.
    """
    spark = nodes.sparkSession
    sent = spark.sparkContext.broadcast((centroids, most or {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("grp").to_numpy(zero_copy_only=False)
            for g in np.unique(groups).tolist():
                rows = np.flatnonzero(groups == g)
                c, bound = (part.get(g) for part in sent.value)
                if c is None or len(c) < 2:
                    blocks = [(np.arange(len(rows)), np.zeros(len(rows), np.int64), np.ones(len(rows), bool))]
                else:
                    blocks = near_shards(matrix(batch.column("embedding").take(pa.array(rows))), c, similarity, bound, True)
                for i, shard, home in blocks:
                    row = pa.array(rows[i])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("node").take(row),
                            batch.column("grp").take(row),
                            pa.array(shard),
                            pa.array(home),
                            batch.column("copies").take(row),
                            batch.column("embedding").take(row),
                        ],
                        ["node", "grp", "shard", "home", "copies", "embedding"],
                    )

    kind = nodes.schema["embedding"].dataType.simpleString()
    schema = f"node bigint, grp bigint, shard bigint, home boolean, copies bigint, embedding {kind}"
    return nodes.select("node", "grp", "copies", "embedding").mapInArrow(run, schema)


def place_centroids(nodes: DataFrame, shard_rows: int) -> tuple[dict[int, np.ndarray], dict]:
    """Centroids per group that needs more than one shard, from a bounded sample.

    Groups get one centroid per ``shard_rows`` nodes, all fewer when they are over
    ``CENTROIDS`` in total; a few rounds of k-means place them. The second result holds, per
    group, ids and vectors of at most ``AUDITED`` sampled nodes.
    """
    sizes = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows)
    total = sizes.agg(F.sum("n")).first()[0]
    if not total:
        return {}, {}
    want = max(1, min(SAMPLE_ROWS, 24 * total // shard_rows))
    big = sizes.orderBy(F.desc("n"), "grp").limit(CENTROIDS).toPandas().set_index("grp")["n"]
    share = min(1.0, CENTROIDS * shard_rows / total)
    keyed = nodes.join(F.broadcast(nodes.sparkSession.createDataFrame(pd.DataFrame({"_g": big.index}), "_g bigint")), F.col("grp") == F.col("_g"))
    rows = keyed.select("node", "grp", "embedding", F.xxhash64("node").alias("h")).orderBy("h").limit(want).toArrow()
    groups, ids, out, sample = rows.column("grp").to_numpy(), rows.column("node").to_numpy(), {}, {}
    for g, n in big.items():
        at = np.flatnonzero(groups == g)
        x = matrix(rows.column("embedding").take(pa.array(at)))
        k = min(len(x), int(np.ceil(n * share / shard_rows)))
        if k < 2:
            continue
        c = x[:k].copy()
        for _ in range(8):
            first = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
            for j in np.unique(first):
                c[j] = x[first == j].mean(axis=0)
        out[int(g)], sample[int(g)] = c, (ids[at[:AUDITED]], x[:AUDITED])
    return out, sample


def graph_edges(members: DataFrame) -> DataFrame:
    """``(node, near)``: adjacency lists, united over the parts a node is in."""

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        near = shard_graph(matrix(table.column("embedding")))
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum([len(a) for a in near])]).astype(np.int32)),
            pa.array(ids[np.concatenate(near)] if near else ids[:0]),
        )
        return pa.table({"node": pa.array(ids), "near": lists})

    lists = members.groupBy("grp", "shard", "part").applyInArrow(build, "node bigint, near array<bigint>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def search_rows(linked: DataFrame) -> DataFrame:
    """Rows of the search's groups: members of a part, and queries of the shard's other parts.

    Foreign queries come in ``chunks`` of a shard; the members are in all of them and ask in
    the first, so a group stays bounded however many queries a shard has.
    """
    columns = ["node", "grp", "shard", "part", "chunk", "asked", "home", "copies", "embedding", "near", "member"]
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = linked.withColumn("chunk", numbers("chunks")).withColumns(
        {"asked": F.col("home") & (F.col("chunk") == 0), "member": F.lit(True)}
    )
    foreign = (
        linked.where("home AND parts > 1")
        .withColumn("own", F.col("part"))
        .withColumn("part", numbers("parts"))
        .where("part <> own")
        .withColumns(
            {
                "chunk": F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"),
                "asked": F.lit(True),
                "near": F.array().cast("array<bigint>"),
                "member": F.lit(False),
            }
        )
    )
    return members.select(columns).union(foreign.select(columns))


def searched(rows: DataFrame, similarity: float, beam: int = BEAM) -> DataFrame:
    """``(node, root, links)``: per query its links in a part, and per node a representative
    of what it is linked with there. A visitor asks nowhere but at home, so what finds it
    elsewhere counts for it too. ``rows`` are those of ``search_rows``."""

    def search(table: pa.Table) -> pa.Table:
        member = table.column("member").to_numpy(zero_copy_only=False).astype(bool)
        home = table.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        visitor = ~table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        order = np.concatenate([np.flatnonzero(member), np.flatnonzero(~member)])
        table = table.take(pa.array(order))
        n, home, visitor = int(member.sum()), home[order], visitor[order]
        ids, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        x = matrix(table.column("embedding"))
        near = table.column("near").combine_chunks()
        near = near if isinstance(near, pa.Array) else pa.concat_arrays(near.chunks)
        rank = np.argsort(ids[:n], kind="stable")
        flat = near.slice(0, n).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.nan_to_num(np.asarray(near.slice(0, n).value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
        at = np.minimum(np.searchsorted(ids[:n][rank], flat), max(0, n - 1))
        here = ids[:n][rank][at] == flat if n else np.zeros(0, bool)
        owner = np.repeat(np.arange(n), size)
        target, owner = rank[at][here] if n else at, owner[here]
        begin = np.searchsorted(owner, np.arange(n + 1))
        asked = np.flatnonzero(home) if n else np.empty(0, np.int64)
        asked = asked[np.argsort(mix(ids[asked].astype(np.uint64)), kind="stable")]
        labels, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        step = max(1, CELLS // max(1, n))
        if len(asked):
            finder = Searcher(x[:n], begin, target, similarity, beam)
            exact = finder.falls_short(asked, x, step)
        for low in range(0, len(asked), step):
            block = asked[low : low + step]
            q, node = finder.links(block, x, exact)
            links[block] = np.bincount(q, copies[node], minlength=len(block)).astype(np.int64)
            away = visitor[node]
            np.add.at(links, node[away], copies[block[q[away]]])
            labels = joined_labels(len(ids), labels[block[q]], labels[node])[labels]
        rows = np.flatnonzero(home | (links > 0) | (labels != np.arange(len(ids))))
        return pa.table(
            {
                "node": pa.array(ids[rows]),
                "root": pa.array(ids[labels[rows]]),
                "links": pa.array(links[rows]),
            }
        )

    return rows.groupBy("grp", "shard", "part", "chunk").applyInArrow(search, "node bigint, root bigint, links bigint")


def vector_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    similarity: float = SIMILARITY,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row.

    Vectors link when their labels are equal and not null, they have equal length and their
    cosine is at least ``similarity``. Null and zero vectors and those with a null or
    non-finite component link with nothing. ``component_id`` is the smallest id reachable,
    ``kept`` whether it is the row's own. Rows of equal vectors are linked with each other;
    repeated ids stay as rows; a null id names no component. Other columns are ignored.
    """
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding")
    )
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(
        F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0),
        F.lit(False),
    )
    keyed = rows.withColumn("code", F.when(sound, F.xxhash64("label", "embedding")))
    same = (
        keyed.where("code IS NOT NULL")
        .groupBy("code", "label", "embedding")
        .agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    )
    nodes = materialised(
        same.withColumn("node", F.monotonically_increasing_id())
        .withColumn("grp", F.xxhash64("label", F.size("embedding")))
    )
    centroids, sample = place_centroids(nodes, shard_rows)
    most = shards_needed(nodes, centroids, sample, similarity)
    counted = materialised(assigned(nodes, centroids, similarity, most))
    sizes = materialised(
        counted.groupBy("grp", "shard").agg(
            F.ceil(F.count(F.lit(1)) / (2 * shard_rows)).cast("int").alias("parts"),
            F.greatest(F.lit(1), F.ceil(F.count_if("home") / shard_rows)).cast("int").alias("chunks"),
        )
    ).withColumn("chunks", F.when(F.col("parts") > 1, F.col("chunks")).otherwise(1))
    with_parts = counted.join(sizes, ["grp", "shard"])
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    members = materialised(with_parts.withColumn("part", part))
    adjacency = materialised(graph_edges(members))
    linked = materialised(members.join(adjacency, "node", "left"))
    found = materialised(searched(search_rows(linked), similarity))
    groups = components(found.where("node <> root"), "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = materialised(
        nodes.select("node", "code", "label", "embedding", "least_id", "copies")
        .join(links, "node", "left")
        .join(groups, "node", "left")
        .withColumn("label_node", F.coalesce(groups["label"], F.col("node")))
        .select("node", "code", nodes["label"], "embedding", "least_id", "label_node",
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    least = materialised(named.groupBy("label_node").agg(F.min("least_id").alias("component_id")))
    result = materialised(
        named.join(least, "label_node").select(
            F.col("code").alias("_code"), F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "n_links", "component_id"
        )
    )
    match = (keyed["code"] == result["_code"]) & (keyed["label"] == result["_label"]) & (keyed["embedding"] == result["_embedding"])
    full = keyed.join(result, match, "left")
    component = F.when(F.col("_code").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return full.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
