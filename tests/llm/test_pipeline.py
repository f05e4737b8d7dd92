import corpus_pipeline
from phenoframe.llm import quality
from tests.llm.test_packing import check_packing, encoded
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_postings import brute as brute_hits
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def masked(text):
    """Base entities masked, overlapping ones once."""
    if text is None:
        return None
    out, to = "", 0
    for start, rank, end in brute_spans(text):
        if start >= to:
            out += text[to:start] + "[" + ["EMAIL", "IP", "CARD", "PHONE"][rank] + "]"
        to = max(to, end)
    return out + text[to:]


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.quality_scores(docs, labels).collect()
    good = stages["quality"](spark, docs, SF)
    rows = {r["doc_id"]: r for r in good.collect()}
    assert good.columns == columns and set(rows) == {r["doc_id"] for r in scored if r["predicted"]}

    one = stages["near_duplicates"](spark, good, SF)
    groups = brute_components(list(rows), [brute_fingerprint(r["text"]) for r in rows.values()])
    rows = {i: r for i, r in rows.items() if groups[i] == i}
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == set(rows)

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = stages["decontamination"](spark, one, SF)
    hits = brute_hits([(i, r["text"]) for i, r in rows.items()], items)
    rows = {i: r for i, r in rows.items() if not hits[i][3]}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == set(rows)

    private = stages["personal_data"](spark, clean, SF)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in private.collect()}
    assert private.schema == clean.schema
    assert got == {i: (masked(r["text"]), len(masked(r["text"]))) for i, r in rows.items()}

    check_packing(corpus_pipeline.run(spark, SF).collect(), encoded(spark, private))


def test_odd_rows_pass_every_stage(spark):
    rows = [(None, None, "en", "s", 0), (1, "", "en", None, 0), (1, "", None, "s", None), (2, "a long enough clean text of words", "en", "s", 9), (2, "another text with quite different words", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    texts = [r["text"] or "" for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()]
    assert sorted(texts) == ["", "a long enough clean text of words", "another text with quite different words"]
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.decontamination_stage):
        stage(spark, docs, SF).collect()
        assert stage(spark, docs.where("false"), SF).collect() == []
    clean = corpus_pipeline.personal_data_stage(spark, docs, SF).collect()
    assert sorted(r["n_chars"] for r in clean if r["n_chars"] is not None) == [0, 0, 33, 39]


def test_columns_named_like_the_row_key_stay(spark):
    rows = [(1, "one text of some words here", 5, "k", 7, 8), (2, "one text of some words here", 6, "l", 7, 8), (3, "other words", 7, "m", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, _KEY string, _id int, _y int")
    for stage in (corpus_pipeline.near_duplicate_stage, corpus_pipeline.decontamination_stage):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {(r["doc_id"], r["_KEY"]) for r in out.collect()} <= {(1, "k"), (2, "l"), (3, "m")}
    assert {(r["doc_id"], r["_KEY"]) for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()} <= {(1, "k"), (2, "l"), (3, "m")}
