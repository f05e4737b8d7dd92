import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoframe.llm import vectors
from phenoframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, similarity=0.93):
    """Links and components of (id, vector, label) rows."""
    sound = [v is not None and l is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, l in rows]
    n = len(rows)
    links, label = np.zeros(n, int), list(range(n))
    unit = [np.asarray(r[1], float) / np.linalg.norm(r[1]) if ok else None for r, ok in zip(rows, sound)]
    pairs = [(i, j) for i in range(n) for j in range(i) if sound[i] and sound[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= similarity]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
        a, b = label[i], label[j]
        if a != b:
            label = [b if x == a else x for x in label]
    least = {}
    for r, c in zip(rows, label):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return [(r[0], int(k), least.get(c)) for r, k, c in zip(rows, links, label)]


def test_query_equals_brute_force(spark):
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in QUERIES["op5_vector_groups"](spark, SF).collect()}
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got == {i: (k, c, i == c) for i, k, c in brute(rows)}


@pytest.mark.parametrize("shard_rows", [2048, 60])
def test_recall_with_clusters_shards_and_parts(spark, shard_rows):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + 0.12 * rng.normal(size=16)).astype(np.float32).tolist(), 1) for i in range(300)]
    rows += [(i, (base[0] + 0.05 * rng.normal(size=16)).astype(np.float32).tolist(), 1) for i in range(300, 500)]
    rows += [(i, rng.normal(size=16).astype(np.float32).tolist(), 2) for i in range(500, 650)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.vector_groups(df, shard_rows=shard_rows).collect()}
    want = {i: (k, c) for i, k, c in brute(rows)}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.97


def test_edge_cases(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [
        (1, a, 1), (2, a, 1), (2, a, 1), (3, [2.0, 0.0], 1), (4, a, 2), (5, a, None), (6, a, None), (7, None, 1), (8, [0.0, 0.0], 1),
        (9, [float("nan"), 1.0], 1), (10, [None, 1.0], 1), (11, [float("inf"), 1.0], 1), (12, b, 1), (None, b, 1), (13, [1.0, 0.0, 0.0], 1), (14, [], 1), (None, [3e38, 3e38], 1),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id bigint, embedding array<float>, label int, node int")
    got = sorted((tuple(r) for r in vectors.vector_groups(df).select("vec_id", "n_links", "component_id").collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert vectors.vector_groups(df.where("false")).collect() == []


def crowd(hot, pairs, dim=64):
    """Unit vectors: one group of near copies and pairs of their own, mixed; links of each."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(pairs, dim))
    x = np.concatenate([rng.normal(size=dim) + 0.1 * rng.normal(size=(hot, dim)), base, base + 0.1 * rng.normal(size=(pairs, dim))])
    x = x[rng.permutation(len(x))].astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, (x @ x.T >= 0.93).sum(axis=1) - 1


def test_pairs_beside_a_large_group_are_found(spark):
    x, due = crowd(1000, 600)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vectors.vector_groups(df).collect()}
    few = np.flatnonzero(due == 1)
    assert len(few) == 1200 and np.mean([got[i] == 1 for i in few]) >= 0.99


def test_audit_sees_lost_links_of_few_beside_many():
    x, due = crowd(300, 200)
    n = len(x)
    large = np.flatnonzero(due > 100)
    near = [large if due[i] > 100 else np.empty(0, int) for i in range(n)]  # pairs have no edges
    begin = np.concatenate([[0], np.cumsum([len(a) for a in near])])
    finder = vectors.Searcher(x, begin, np.concatenate(near), 0.93, vectors.BEAM)
    every = np.arange(n)
    loose = np.bincount(finder.links(every, x, False)[0], minlength=n)
    assert loose.sum() > 0.99 * due.sum() and finder.falls_short(every, x, n)
    assert (np.bincount(finder.links(every, x, True)[0], minlength=n) == due).all()


def test_shards_of_many_centroids_in_bounded_memory():
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(1500, 32)), rng.normal(size=(700, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    tracemalloc.start()
    got = {(i, j, h) for block in vectors.near_shards(x, c, 0.99) for i, j, h in zip(*(a.tolist() for a in block))}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    first = d.argmin(axis=1)
    gap = np.linalg.norm(c[first][:, None, :] - c[None], axis=2)
    i, j = np.nonzero(d - d.min(axis=1)[:, None] <= 2 * np.sqrt(0.02) * gap + 1e-9)
    assert {(a, b) for a, b, _ in got} >= set(zip(i.tolist(), j.tolist())) and len(got) <= len(i) + 5
    assert {(a, b) for a, b, h in got if h} == set(enumerate(first.tolist()))
    assert peak < 1500 * 700 * 32 * 8 / 2  # half of the rows x centroids x dim table


def brute_links(x):
    """Links and smallest reachable number of unit rows."""
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    least = np.arange(len(x))
    while True:
        lower = np.minimum(least, np.where(near, least[None, :], len(x)).min(axis=1))
        if (lower == least).all():
            return near.sum(axis=1), least
        least = lower


def test_three_thousand_vectors_of_one_label_in_many_shards(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2500, 24))
    step = np.concatenate([0.06 * rng.normal(size=(800, 24)), 0.07 * rng.normal(size=(200, 24))])
    x = np.concatenate([x, x[np.concatenate([np.arange(800), np.zeros(200, int)])] + step])
    x = x[rng.permutation(len(x))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links, least = brute_links(x)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.vector_groups(df, shard_rows=60).collect()}
    found = np.array([got[i][0] for i in range(len(x))])
    linked = links > 0
    assert (found <= links).all() and (found[linked] / links[linked]).mean() >= 0.97
    assert np.mean([got[i][1] == least[i] for i in range(len(x))]) >= 0.97


@pytest.mark.parametrize("k", [8, 64, 512])
def test_uniform_vectors_join_few_shards(k):
    rng = np.random.default_rng(7)
    x, c = rng.normal(size=(3000, 64)), rng.normal(size=(k, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c *= 0.4 / np.linalg.norm(c, axis=1, keepdims=True)
    rows = sum(len(i) for i, _, _ in vectors.near_shards(x, c, 0.93, vectors.NEAR_SHARDS, True))
    assert rows < 4 * len(x)
    ranks = vectors.shard_ranks(x, c)
    assert (vectors.simulated_levels(x, ranks, c, 0.93) == 0).mean() >= 0.9


def test_of_two_shards_one_visits_the_other():
    a, b = np.meshgrid(np.arange(40), np.arange(40))
    assert (vectors.visits(a, b) ^ vectors.visits(b, a))[a != b].all() and not vectors.visits(a, b)[a == b].any()
    share = vectors.visits(a, b).mean(axis=0)
    assert share.min() > 0.4 and share.max() < 0.6


def test_linked_pairs_meet_once_without_a_bound():
    x, due = crowd(100, 300, 16)
    c = x[:40] * 0.5
    shards, home = [set() for _ in x], [None] * len(x)
    for i, j, h in ((i, j, h) for block in vectors.near_shards(x, c, 0.93, None, True) for i, j, h in zip(*(a.tolist() for a in block))):
        shards[i].add(j)
        if h:
            home[i] = j
    near = [(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.93)) if i < j]
    assert all((home[j] in shards[i]) + (home[i] in shards[j]) == 1 + (home[i] == home[j]) for i, j in near)


def test_groups_of_the_search_stay_bounded(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("node"), F.lit(0).alias("grp"), F.lit(0).alias("shard"), (F.col("id") % 10).cast("int").alias("part"),
        F.lit(10).alias("parts"), F.lit(20).alias("chunks"), F.lit(True).alias("home"), F.lit(1).alias("copies"),
        F.array(F.lit(1.0)).alias("embedding"), F.array().cast("array<bigint>").alias("near"),
    )
    sizes = vectors.search_rows(rows).groupBy("grp", "shard", "part", "chunk").agg(
        F.count_if("member").alias("members"), F.count_if(~F.col("member")).alias("foreign"), F.collect_list(F.when(F.col("asked"), F.col("node"))).alias("asked")
    ).collect()
    assert len(sizes) == 200 and all(r["members"] == 400 and r["foreign"] <= 300 for r in sizes)  # 3,600 foreign ones in all
    for part in range(10):
        assert sorted(n for r in sizes if r["part"] == part for n in r["asked"]) == list(range(4000))
