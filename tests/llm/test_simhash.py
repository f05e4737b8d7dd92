import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from phenoframe.llm import simhash
from phenoframe.llm.graph import components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    best = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for i, x in zip(ids, fps):
            low = min(best[j] for j, y in zip(ids, fps) if (x ^ y).bit_count() <= 4)
            changed |= low < best[i]
            best[i] = min(best[i], low)
    return best


@pytest.mark.parametrize(
    "text",
    ["", "one", "A b\tC", "x\x1cy z\x0bw q r", "É È é è", "word " * 300, " a b c d e", "  Lead and trail  "],
)
def test_fingerprint(text):
    assert simhash.fingerprint_of(text.encode()) == brute_fingerprint(text)


def test_query_equals_brute_force(spark):
    from phenoframe.llm.queries import QUERIES

    rows = QUERIES["op8_simhash"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    want = brute_components(list(fps), list(fps.values()))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {
        i: (f"{fps[i]:016x}", want[i]) for i in docs
    }


@pytest.mark.parametrize("bucket_rows", [8192, 50])
def test_links_hold_all_components(spark, bucket_rows):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(500)}
    ids = sorted(fps)
    signed = np.array(ids, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    groups = components(simhash.fingerprint_links(df, bucket_rows), "fp", "other").collect()
    got = {}
    for r in groups:
        got.setdefault(r["label"], set()).add(r["node"] % (1 << 64))
    want = brute_components(ids, ids)
    sets = {}
    for i, c in want.items():
        sets.setdefault(c, set()).add(i)
    assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in sets.values() if len(s) > 1}


def test_large_run_is_compared_in_blocks():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64)) for b in base])
    labels = simhash.block_labels(fps)
    want = brute_components(range(300), [int(x) for x in fps])
    assert labels.tolist() == [want[i] for i in range(300)]


def test_path_of_links(spark):
    edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    odd = spark.createDataFrame([(7, 7), (None, 3), (1000, 1001)], "a bigint, b bigint")
    rows = components(edges.union(odd), "a", "b").collect()
    assert len({r["label"] for r in rows if r["node"] <= 400}) == 1
    assert {r["node"] for r in rows} == set(range(401)) | {1000, 1001}


def test_edge_cases(spark):
    rows = [(3, None, 1), (2, "", 1), (2, "", 1), (None, "one two three four five", 1), (9, "one two three four five", 1), (4, "x " * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in simhash.simhash_groups(df).collect()))
    assert got == [(-1, 9), (2, 2), (2, 2), (3, 2), (4, 4), (9, 9)]
    assert simhash.simhash_groups(df.where("false")).collect() == []
