import hashlib
import random

import pytest
from pyspark.sql import functions as F

from phenoframe.llm import merkle
from phenoframe.llm.queries import FIELDS


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS])


def levels(nodes):
    """All levels of a tree of arity three, from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def beside(tree, at):
    out = []
    for level in tree[:-1]:
        low = at // 3 * 3
        out.append(("".join(level[low:at]), "".join(level[at + 1 : low + 3])))
        at //= 3
    return out


def brute(rows):
    """Sorted ``(doc_id, leaf, subroot, root, witness)`` of rows given as dicts."""
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)), r["doc_id"]) for r in rows if r["source"] == s)
        trees[s] = [i for _, i in own], levels([k[2] for k, _ in own])
    top = levels([trees[s][1][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        ids, tree = trees[s]
        for at, i in enumerate(ids):
            out.append((i, tree[0][at], tree[-1][0], top[-1][0], beside(tree, at) + beside(top, n)))
    return sorted(out, key=repr)


def grown(docs, height, found=None):
    rows = merkle.dataset_manifest(docs, FIELDS, "doc_id", "source", found, height)
    rows = rows.withColumn("folded", merkle.folded(F.col("claim"), F.col("witness"))).collect()
    return rows, sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(w) for w in r["witness"]]) for r in rows], key=repr)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, block int, claim string, digest int, root string, _at int"


@pytest.mark.parametrize("height", [1, 2, 7])
def test_witnesses_equal_brute_force(spark, height):
    rng = random.Random(height)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", "", "é", "Z", "\U0001f600", "￮"]), "en", i, f"text {i}\n\nline") for i in range(230)]
    rows += [(None, "hot", None, None, None), (None, None, "en", 1, ""), (7, "hot", "en", 7, "again"), (7, "hot", "en", 7, "again")]
    rows += [(900, "long", "en", 10**6, "long\n" * 200_000)]
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2, "z", 3) for r in rows], SCHEMA)
    tampered = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    raw, got = grown(docs, height, {"text": tampered})
    want = brute([dict(zip(FIELDS, (r[0], r[1], r[2], r[3], r[4]))) for r in rows])
    assert got == want
    for r in raw:
        changed = r["doc_id"] is not None and r["doc_id"] % 2 == 0
        assert (r["folded"] == r["root"]) != changed and (r["claim"] == r["leaf"]) != changed


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_every_size_of_a_single_source(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit("en").alias("lang"), F.col("id").alias("n_chars"), F.lit(None).cast("string").alias("text"))
    raw, got = grown(docs, 1)
    assert got == brute([r.asDict() for r in docs.collect()]) and all(r["folded"] == r["root"] for r in raw)


def test_appending_one_block_equals_levels():
    for n in range(1, 60):
        tree, leaves = merkle.Witnesses(), [sha(str(i)) for i in range(n)]
        for leaf in leaves:
            tree.append(leaf)
        want = levels(leaves)
        assert tree.finish(None) == want[-1][0]
        assert [[(w["before"], w["after"]) for w in t] for t in tree.witnesses] == [beside(want, i) for i in range(n)]


def test_empty_table_and_order_of_input(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert grown(docs, 2) == ([], [])
    rows = spark.createDataFrame([(i, "s", "en", 1, str(i)) for i in range(50)], docs.schema)
    assert grown(rows.orderBy(F.rand(1)), 2)[1] == grown(rows.repartition(3), 2)[1]
