import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from phenoframe.llm import trie
from phenoframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    """Turns ``(role, text)`` per conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[conv].append((turn is not None, turn or 0, name, role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}


def borrowed(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(family, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved, out = {}, {}, []
    for key in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        leaves[key] = sum(leaves[k] for k in children[key]) or 1
        saved[key] = (len(members[key]) - 1) * words + sum(saved[k] for k in children[key])
        ends = sorted(c for c in members[key] if len(convs[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members[key]), len(key), parent, len(members[key]), len(children[key]), leaves[key], saved[key], sha))
    return sorted(out)


def made(rows):
    return sorted(tuple(r[c] for c in COLUMNS) for r in rows.collect())


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert made(QUERIES["op11_trie"](spark, SF)) == brute(borrowed(ordered(rows)))


def odd_rows():
    rng = random.Random(5)
    rows, talk = [], [("user", f"say {i} \t\x0b now") for i in range(40)]
    for c in range(-25, 60):
        turns = talk[: rng.randrange(9)] + [("bot", rng.choice("ab"))] * rng.randrange(4)
        rows += [(c, t, *turn) for t, turn in enumerate(turns)]
    for c in range(200, 260):  # one common conversation
        rows += [(c, t, *turn) for t, turn in enumerate(talk[:6])]
    for c in (300, 301, 5000):  # long ones that part late
        rows += [(c, t, "user", "x y") for t in range(70)] + [(c, 70 + t, "bot", f"{c % 300}") for t in range(5)]
    rows += [(400, None, None, None), (400, None, "", ""), (400, 1, "u", None), (400, 1, "u", "tie"), (400, 1, "a", "tie"), (400, 1, "u", "tie")]
    rows += [(None, 1, "u", "nobody"), (None, None, None, None), (461, 0, "u", "base is missing"), (2**62, 0, "u", "long " * 100_000)]
    rows += [(500, 0, "ab", "c"), (520, 0, "a", "bc"), (540, 0, "a", "bc ")]
    return rows


SCHEMA = "conv_id bigint, turn int, role string, text string, digest int, words string, size string, x1 string"


@pytest.mark.parametrize("block, span", [(1, 2), (3, 1), (4, 1024), (16, 2)])
def test_tries_of_odd_conversations(spark, block, span):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 0, "w", "s", "x") for r in rows], SCHEMA).repartition(5)
    turns = trie.turns_of(df, "conv_id", "turn", "role", "text")
    assert made(trie.prefix_trie(trie.plain(turns), block, span)) == brute(ordered(rows))
    conv = F.col("conv_id")
    other = trie.rebuilt(turns, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
    assert made(trie.prefix_trie(other, block, span)) == brute(borrowed(ordered(rows)))


def test_no_conversations_and_no_turns(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    turns = trie.turns_of(empty, "conv_id", "turn", "role", "text")
    assert made(trie.prefix_trie(trie.plain(turns))) == []
    one = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    rows = [(one, 0, "u", "only turn")]
    turns = trie.turns_of(spark.createDataFrame(rows, empty.schema), "conv_id", "turn", "role", "text")
    conv = F.col("conv_id")
    bare = trie.rebuilt(turns, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
    assert made(trie.prefix_trie(bare)) == brute(borrowed(ordered(rows)))


def test_only_blocks_with_siblings_are_refined(spark):
    rows = [(c, t, "u", "same" if t < 8 else f"{c}") for c in range(6) for t in range(12)]
    turns = trie.turns_of(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), "conv_id", "turn", "role", "text")
    blocks = trie.blocks_of(trie.plain(turns), 4).collect()
    states = {(b["j"], b["a1"], b["a2"]) for b in blocks}
    assert len(blocks) == 18 and len(states) == 8
    assert made(trie.prefix_trie(trie.plain(turns), 4)) == brute(ordered(rows))
