import hashlib
import random
import re

from pyspark.sql import functions as F

from phenoframe.llm import pii
from phenoframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    spans = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), rank, m.end()))
    return sorted(spans)


def joined(spans):
    return ",".join(f"{list(BASE)[r]}:{s}:{e}" for s, r, e in spans)


def check(rows, texts):
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[1] == i for x in want) for i in range(4)]
        assert set(filter(None, joined(want).split(","))) <= set(filter(None, r["spans"].split(",")))


def test_query_equals_brute_force(spark):
    rows = QUERIES["op9_pii"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    check(rows, texts)


def test_base_on_random_texts(spark):
    rng = random.Random(11)
    parts = ["1", "23", "0", "255", "256", ".", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "_", "é", "😀", "4111111111111111", "\n", "a@b.c", "+1 (555) 555-0100", "1.2.3.4"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for i in range(1500)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    spans = pii.entity_spans(df)
    got = spans.select("row.doc_id", "base").collect()
    for r in got:
        assert [tuple(b) for b in r["base"]] == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_patterns_discover_further_entities(spark):
    names = [f"user{i}@mail.example.com" for i in range(6)]
    rows = [(i, f"some words and contact address: {n} for more", 0) for i, n in enumerate(names)]
    rows += [(10, "please see contact address: user9@intranet for more", 0), (11, "room user9@intranet too", 0), (12, "and version 12 for some", 0)]
    rows += [(20 + i, f"host 10.0.0.{i} is up", 0) for i in range(5)] + [(30, "host 10.0.0.999 is up", 0), (31, "clean text", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key int")
    got = {r["doc_id"]: r["all"] for r in pii.entity_spans(df).select("row.doc_id", pii.spans_text(F.col("spans")).alias("all")).collect()}
    text = dict((r[0], r[1]) for r in rows)
    assert got[10] == f"email:{text[10].index('user9')}:{text[10].index(' for')}" and got[11] == "email:5:19"
    assert got[12] == "" and got[31] == "" and got[30] == "ip:5:15"


def test_redaction_and_edge_cases(spark):
    rows = [
        (1, "é😀 a@b.c, then +1 (555) 555-0100.", 5), (1, "é😀 a@b.c, then +1 (555) 555-0100.", 5), (2, None, 5), (None, "", 5),
        (3, "x" * 100_000 + " a@b.c " + "1." * 4_000 + " 9" * 20_000 + "@", 5), (4, "a@b.c " * 3000, 5), (5, "nothing", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row int")
    got = sorted(pii.redact(df).collect(), key=str)
    assert pii.redact(df).schema == df.schema
    masked = "é😀 [EMAIL], then [PHONE]."
    assert [r["text"] for r in got if r["doc_id"] == 1] == [masked, masked]
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[2] is None and texts[None] == "" and texts[4] == "[EMAIL] " * 3000 and texts[5] == "nothing"
    assert "x [EMAIL] [IP].[IP]." in texts[3]
    assert pii.redact(df.where("false")).collect() == []


def test_discovered_entities_teach_new_patterns(spark):
    rows = [f"please call desk +1555010{i:04d} today again" for i in range(40)]
    rows += [f"please call desk 555-0200-{i:02d} today again" for i in range(10)]
    rows += [f"or reach hotline 555-0200-{i:02d} now and here" for i in range(10)]
    rows += [f"or reach hotline 555-0300-{i:02d} now and here" for i in range(2)]  # second generation
    rows += [f"ask bureau {n} soon please" for n in [f"555-0200-{i:02d}" for i in range(9)] + ["555-0300-00", "555-0300-01", "555-0400-00"]]  # third
    rows += ["the part 555-0900-00 fits", "order 12 of 2021"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    found = pii.entity_spans(df).select("row.doc_id", "base", "spans").collect()
    added = {r["doc_id"]: [rows[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for r in found if len(r["spans"]) > len(r["base"])}
    assert {i for i in range(40, 74)} == set(added)
    assert added[60] == ["555-0300-00"] and added[61] == ["555-0300-01"] and added[73] == ["555-0400-00"]
