import collections
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from phenoframe.llm import binpack, cutting, packing
from phenoframe.llm.queries import QUERIES
from phenoframe.llm.tokens import Encoder, default_path

SF = "/root/testdata/sf0.001"
ODD = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "null id", 5), (3, "long text " * 30_000, 5), (4, "a  b\n\n c <|endoftext|> \x1c", 5)]


def encoded(spark, df):
    tokenizer = Tokenizer.from_file(default_path())
    return [(r["doc_id"], [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string, length int")


def test_encoder_equals_tokenizer():
    rng, encoder = random.Random(1), Encoder()
    parts = list(" \n\t\x85\xa0\x1c　abcZé²½9'.,!中ªµ٣") + ["'s", "<|endoftext|>", "  ", "don't", " word", "\n "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want, repr(text)


def check_packing(rows, docs):
    ids = collections.defaultdict(list)
    for d, x in docs:
        ids[d].append(x)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d, texts in ids.items():
        copies = len(texts)
        want = collections.Counter((at, zlib.crc32(np.array(x[at : at + 2048], "<u4").tobytes()), len(x)) for x in texts for at in range(0, len(x), 2048))
        assert collections.Counter((r["start"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[d]) == want, copies
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(r["length"] for r in rows) / (2048 * max(1, len(sequences)))


def test_query_packs_every_id(spark):
    rows = QUERIES["op6_packing"](spark, SF).collect()
    fill = check_packing(rows, encoded(spark, spark.read.parquet(f"{SF}/documents.parquet")))
    assert fill > 0.98


def test_packing_edge_cases(spark, odd):
    rows = packing.pack_documents(odd, with_ids=True).collect()
    check_packing(rows, encoded(spark, odd))
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert packing.pack_documents(odd.where("false")).collect() == []


def test_patterns_pack_all_items_close_to_the_bound():
    rng = np.random.default_rng(2)
    sizes = np.unique(rng.integers(20, 200, 60))
    demand = rng.integers(1, 5000, len(sizes))
    plan = cutting.solve(sizes, demand, 512)
    assert (sum(p * n for p, n in plan) == demand).all() and all(p @ sizes <= 512 for p, _ in plan)
    bins = sum(n for _, n in plan)
    assert bins <= 1.01 * (sizes @ demand) / 512


def test_knapsack_equals_brute_force():
    rng = random.Random(4)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(2, 12), 4)))
        values = np.array([rng.random() for _ in sizes])
        best = 0.0
        for a in range(11):
            for b in range(11):
                for c in range(11):
                    for d in range(11):
                        if np.dot([a, b, c, d], sizes) <= 20:
                            best = max(best, float(np.dot([a, b, c, d], values)))
        worth, pattern = cutting.best_pattern(sizes, values, 20)
        assert worth == pytest.approx(best) and pattern @ values == pytest.approx(best) and pattern @ sizes <= 20


def test_room_tree():
    rng, tree, rooms = random.Random(3), binpack.RoomTree(37), collections.Counter()
    for _ in range(2000):
        x = rng.randint(0, 37)
        found = tree.least_from(x)
        assert found == min((r for r, n in rooms.items() if n and r >= x), default=-1)
        if found >= 0 and rng.random() < 0.5:
            tree.add(found, -1)
            rooms[found] -= 1
        else:
            tree.add(x, 1)
            rooms[x] += 1


def check_files(spark, manifest, folder, docs):
    whole, rows = collections.defaultdict(list), manifest.collect()
    files = {r["file"]: binpack.read_packed(folder, r["file"]) for r in rows}
    for r in rows:
        ids, places, cuts = files[r["file"]]
        assert cuts[r["row"]].tolist() == r["cu_seqlens"] and r["cu_seqlens"][-1] == r["n_tokens"]
        line = ids[r["row"]]
        assert not line[r["n_tokens"] :].any() and zlib.crc32(line[: r["n_tokens"]].astype("<u4").tobytes()) == r["ids_crc32"]
        for d, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert places[r["row"], a:b].tolist() == list(range(b - a))
            whole[d].append((start, line[a:b].tolist()))
    want = collections.defaultdict(list)
    for d, x in docs:
        want[d] += [(at, x[at : at + 2048]) for at in range(0, len(x), 2048)]
    assert {d: sorted(p) for d, p in whole.items()} == {d: sorted(p) for d, p in want.items()}
    return sum(r["n_tokens"] for r in rows) / (2048 * max(1, len(rows)))


def test_matrices_hold_every_id(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    manifest = binpack.pack_to_files(docs, f"file:{tmp_path}/packed")
    assert check_files(spark, manifest, f"file:{tmp_path}/packed", encoded(spark, docs)) > 0.97
    assert QUERIES["op7_token_matrix"](spark, SF).count() == manifest.count()


def test_matrix_edge_cases(spark, odd, tmp_path):
    manifest = binpack.pack_to_files(odd, str(tmp_path / "odd"), batch_tokens=5000)
    check_files(spark, manifest, str(tmp_path / "odd"), encoded(spark, odd))
    assert binpack.pack_to_files(odd.where("false"), str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("run", [" " * 2_000_000, "\t" * 1_000_000 + "x", "a" + "\n" * 1_000_000, "\x85 " * 600_000])
def test_long_blank_runs_encode(run):
    encoder = Encoder()
    want = encoder.tokenizer.encode(run, add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids(run), "<u4").tolist() == want


def test_tiny_documents_fill_their_sequences(spark):
    rng = random.Random(7)
    rows = [(i, None) for i in range(2500)] + [(i, "word " * rng.randrange(1, 70)) for i in range(2500, 4500)] + [(9000, "x " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for some in (docs, docs.where("doc_id < 2000"), docs.where("doc_id < 3")):
        got = packing.pack_documents(some).collect()
        fill = check_packing(got, encoded(spark, some))
        tokens = sum(r["length"] for r in got)
        assert len({r["sequence_id"] for r in got}) <= tokens / 2048 / 0.95 + 1, fill


def test_bundles_hold_every_rest_once():
    demand = {-1: 1000, -9: 57, -63: 3, 8: 5, 32: 2}
    rows = packing.bundle_rows(dict(demand), 8, 2048)
    assert [(r[0], r[1], r[2]) for r in rows] == [(-63, 4, 0), (-9, 28, 2), (-1, 256, 3)]
    assert packing.bundle_rows({8: 5}, 8, 2048) == []
