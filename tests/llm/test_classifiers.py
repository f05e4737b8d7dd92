import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from phenoframe.llm import language, quality
from phenoframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op2_quality"](spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [i for i in labels if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == labels[i] for i in held]) > 0.97


def test_ranking_orders_pairs_and_cuts_at_the_quantile():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.8).astype(int)
    x = rng.normal(size=(400, 3)) + np.outer(y, [3.0, -3.0, 0.0])
    r = quality.fit_ranking(x, y)
    s = 1 / (1 + np.exp(-(x @ r.weights + r.shift)))
    assert (s < 0.7).sum() == (y == 0).sum() and ((s >= 0.7) == y).mean() > 0.98


def test_measures_by_hand():
    texts = ["", "Aa b! b! b!", None, "x | y"]
    flat, starts = quality.text_bytes(pa.array(texts))
    m = dict(zip(quality.FEATURES, quality.measures(flat, starts).T))
    assert m["bang"].tolist() == pytest.approx([0, math.sqrt(3 / 11), 0, 0])
    assert m["repeated"].tolist() == [0, 0.5, 0, 0] and m["distinct"].tolist() == [0, 0.5, 0, 1]
    assert m["bar"].tolist() == pytest.approx([0, 0, 0, math.sqrt(0.2)])


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0)], [(1, 1), (1, 0)], [(1, 1), (2, 0), (None, 1), (3, None)]])
def test_quality_edge_cases(spark, labels):
    docs = spark.createDataFrame([(1, "fine text", 5), (1, "fine text", 6), (2, None, 7), (None, "", 8), (3, "x " * 99999, 9)], "doc_id bigint, text string, quality int")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = quality.quality_scores(docs, known).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(docs.where("false"), known).collect() == []


def test_language_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op3_language"](spark, SF).collect()}
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(rows) == set(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert np.mean([r["lang_pred"] == docs[i] for i, r in rows.items() if r["held_out"]]) > 0.97


def test_language_counts_equal_brute_force(spark):
    rows = [(1, "Äb, c1d", "x"), (2, "bb", "y"), (3, None, "x"), (4, "zz", None), (5, "12", "y")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = {(r["lang"], r["bucket"]): r["n"] for r in language.count_grams(docs, "text", "lang").collect()}
    want = collections.Counter()
    for _, text, lang in rows:
        if text and lang:
            want[lang, -1] += 1
            clean = "".join(c if c.isalpha() else " " for c in text.lower() + " ")
            clean = " ".join(clean.split()) + " " if clean.split() else ""
            for n in language.ORDERS:
                for i in range(len(clean) - n + 1):
                    p = np.array([ord(c) for c in clean[i : i + n]], np.uint64)
                    want[lang, int(language.grams(p, np.array([0, n]), n, language.BITS)[0][0])] += 1
    assert got == dict(want)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "aaa bbb", "p"), (2, "ccc ddd", "q"), (3, None, "p"), (4, "", "q"), (5, "12 !?", None), (None, "aaa", "p"), (1, "bbb", "p"), (6, "ccc " * 100000, "q"), (7, "中文", None)],
        "doc_id int, text string, lang string",
    )
    model = language.train(docs.where("doc_id < 3"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[None][0] == "p" and got[6][0] == "q" and got[6][1] == 1.0 and 0 <= got[7][1] <= 1
    nothing = language.train(docs.where("false"))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.where("false"), model).collect() == []


def brute_posterior(rows, text):
    """Posteriors of a text by counting n-grams one at a time."""
    size = 1 << language.BITS

    def buckets(t):
        clean = "".join(c if c.isalpha() else " " for c in t.lower() + " ")
        clean = " ".join(clean.split()) + " " if clean.split() else ""
        for n in language.ORDERS:
            for i in range(len(clean) - n + 1):
                p = np.array([ord(c) for c in clean[i : i + n]], np.uint64)
                yield int(language.grams(p, np.array([0, n]), n, language.BITS)[0][0])

    counts, n_rows = collections.defaultdict(collections.Counter), collections.Counter()
    for t, lang in rows:
        counts[lang].update(buckets(t))
        n_rows[lang] += 1
    logs = {}
    for lang, own in counts.items():
        whole = own.total() + 0.5 * size
        logs[lang] = math.log(n_rows[lang] / len(rows)) + sum(math.log((own[b] + 0.5) / whole) for b in buckets(text))
    top = max(logs.values())
    mass = sum(math.exp(x - top) for x in logs.values())
    return min(k for k, v in logs.items() if v == top), 1 / mass


@pytest.mark.parametrize("languages, chunk", [(33, 256), (40, 7), (300, 256)])
def test_any_number_of_languages(spark, languages, chunk):
    rng = np.random.default_rng(languages)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(languages)]
    rows = [(f"{words[i]} {words[(i * 7 + 1) % languages]}", f"l{i:04d}") for i in range(languages)] * 2
    docs = spark.createDataFrame([(n, t, lang) for n, (t, lang) in enumerate(rows)], "doc_id int, text string, lang string")
    model = language.train(docs, chunk=chunk)
    assert model.chunks == -(-languages // chunk)
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert len(got) == len(rows)
    for n in range(0, languages, max(1, languages // 10)):
        want, score = brute_posterior(rows, rows[n][0])
        assert got[n]["lang_pred"] == want and got[n]["score"] == pytest.approx(score, rel=1e-3)
    assert np.mean([got[n]["lang_pred"] == lang for n, (_, lang) in enumerate(rows)]) > 0.95


def test_quality_columns_may_clash(spark):
    rows = [(i, "good long text of words " * 3 if i % 2 else "BAD!! | BAD!!", "a", 1, 2, "b") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _id string, _y int, _z int, _text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] % 2 for r in kept.collect()} == {1}
    assert {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, labels).collect()} == {i: i % 2 for i in range(20)}


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_all_labelled_rows_fit_the_ranking(spark, share):
    rng = np.random.default_rng(5)
    n, k = 24_000, len(quality.FEATURES)
    y = (rng.random(n) < share).astype(int)
    x = rng.normal(size=(n, k)) + np.outer(y, np.linspace(-0.5, 0.5, k))
    known = spark.createDataFrame(
        pa.table({"_id": np.arange(n), "features": pa.array(list(x)), "_y": pa.array(y, pa.int32())}), "_id bigint, features array<double>, _y int"
    )
    got = quality.fit_rows(known, 0.7)
    # in the order in which rows are numbered, the weights are those of the fit in memory
    at = [r["_id"] for r in known.selectExpr("_id", "xxhash64(_id) h").orderBy("h", "_id").select("_id").collect()]
    want = quality.fit_ranking(x[at], y[at])
    assert got.weights == pytest.approx(want.weights, abs=1e-6) and got.shift == pytest.approx(want.shift, abs=1e-6)
    s = 1 / (1 + np.exp(-(x @ got.weights + got.shift)))
    assert (s < 0.7).sum() == (y == 0).sum()


def test_labels_are_not_sampled(spark):
    labels = spark.range(30_000).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS int) AS quality")
    odd = labels.limit(0).unionAll(spark.createDataFrame([(1, 1), (1, 0), (None, 1), (40_000, 1), (40_000, 1)], "doc_id bigint, quality int"))
    rows = quality.labelled_rows(labels.union(odd), "doc_id", "quality")
    assert rows.count() == 30_000 and rows.where("_id = 1").isEmpty()
