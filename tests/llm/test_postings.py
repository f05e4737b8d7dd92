import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from phenoframe.llm import postings
from phenoframe.llm.text import text_bytes, word_hashes, word_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    out = {}
    for d, text in docs:
        words, hit, found = words_of(text), set(), set()
        for i, item in items:
            w = words_of(item)
            if not w:
                continue
            n = min(width, len(w))
            grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found.add(str(i))
        out[d] = (len(words), len(hit), sorted(found), bool(hit))
    return out


def test_random_texts(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "Cé", "dd", "9x", "É"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14)))) for i in range(30)]
    items += [(100, None), (101, "!!"), (3, items[3][1])]
    docs = [(d, ", ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for d in range(80)]
    docs += [(900 + k, "x " * k + items[k][1] + ". y") for k in range(20)] + [(999, None), (998, "")]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([(*r, 0) for r in items], "item_id bigint, text string, doc_id int")
    got = postings.decontaminate(d, i, width=4).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got} == brute(docs, items, 4)
    index = postings.build_index(d)
    one, many = (postings.phrase_matches(index, i, width=4, chunk_bytes=n).select("doc_id", "item_id", "starts").collect() for n in (1 << 20, 100))
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "same words here"), (1, "same words here"), (None, "same words"), (2, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "SAME words"), (None, "here")], "item_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["items"]) for r in postings.decontaminate(docs, items).collect())
    assert got == [(-1, 2, 2, ["7"]), (1, 3, 3, ["7"]), (1, 3, 3, ["7"]), (2, 0, 0, [])]
    assert postings.decontaminate(docs.where("false"), items).collect() == []
    assert [r["n_hit"] for r in postings.decontaminate(docs, items.where("false")).collect()] == [0] * 4


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "p q x r s"), (2, "p q r s"), (3, "p x x q r s"), (4, "s r q p")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "p q r s")], "item_id bigint, text string")
    index = postings.build_index(docs)
    near = lambda k: sorted(r["doc_id"] for r in postings.phrase_matches(index, items, slop=k).collect())
    assert near(0) == [2] and near(1) == [1, 2] and near(2) == [1, 2, 3]


def test_word_hashes_of_long_words():
    text = "ab " + "x" * 3_000_000 + " ab " + "x" * 3_000_000
    flat, starts = text_bytes(pa.array([text, None, "ab"]))
    begins, ends, first = word_spans(flat, starts, postings.WORD_BYTES)
    h = word_hashes(flat, begins, ends)
    assert first.tolist() == [0, 4, 4, 5] and h[0] == h[2] == h[4] and h[1] == h[3] != h[0]
    assert len(np.unique(h)) == 2


def test_repeated_words_stay_small(spark):
    doc = "same " * 20_000 + "other words " * 50
    items = [(i, "same " * (400 + i)) for i in range(6)] + [(6, "same " * 400), (6, "same " * 400), (7, "other words " * 9), (8, "same")]
    rows = [(1, doc), (2, "same " * 9), (3, "x same y"), (4, "a b " + "same " * 11 + "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = postings.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = brute([(i, t) for i, t in rows], items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == {i: (n, h, sorted(map(str, its))) for i, (n, h, its, _) in want.items()}
    phrases = postings.Phrases(pa.array([t for _, t in items]), 10)
    assert len(phrases.words) == 4 and phrases.holders(np.arange(4))[0].size == 8 + 2 + 1
    tracemalloc.start()
    hashes, first = postings.term_stream(*postings.text_bytes(pa.array([doc])))
    order = np.argsort(hashes, kind="stable")
    terms, counts = np.unique(hashes, return_counts=True)
    postings.search(phrases, terms, counts, order, first, 0)
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_blocks_of_candidates_do_not_change_matches(spark, monkeypatch, limit):
    monkeypatch.setattr(postings, "CANDIDATES", limit)
    rng = random.Random(limit)
    texts = pa.array([" ".join(rng.choice("abc") for _ in range(40)) for _ in range(8)])
    phrases = postings.Phrases(pa.array(["a b a", "c", "b b", "a b a c"]), 3)
    hashes, first = postings.term_stream(*postings.text_bytes(texts))
    terms, counts = np.unique(hashes, return_counts=True)
    window, start, doc = postings.search(phrases, terms, counts, np.argsort(hashes, kind="stable"), first, 0)
    words = {int(t): w for w in "abc" for t in postings.term_stream(*postings.text_bytes(pa.array([w])))[0]}
    named = [[words[int(phrases.terms[x])] for x in row if x >= 0] for row in phrases.words]
    want = {(w, int(first[d]) + i, d) for d, t in enumerate(texts.to_pylist()) for w, p in enumerate(named) for i in range(len(t.split()) - len(p) + 1) if t.split()[i : i + len(p)] == p}
    assert set(zip(window.tolist(), start.tolist(), doc.tolist())) == want and len(window) == len(want)
