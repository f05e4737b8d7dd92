"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoframe.llm import binpack, language, licenses, merkle, packing, pii, postings, quality, simhash, trie, urls, vectors, warc
from phenoframe.scale.bounds import materialised, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows where there is any."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents),
i AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark),
iw AS (
    SELECT item_id, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS pos, ws
    FROM i WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, pos, pos + n - 1), ' ') AS gram FROM iw),
dw AS (
    SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS pos, ws
    FROM d, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n),
dg AS (SELECT doc_id, n, pos, array_to_string(list_slice(ws, pos, pos + n - 1), ' ') AS gram FROM dw),
m AS (SELECT doc_id, item_id, pos, n FROM dg JOIN g USING (n, gram)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM m) GROUP BY doc_id),
s AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query("op1_decontamination", OP1_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def remainder(id_col: str, parts: int, kept: int):
    """Whether crc32 of the id as text leaves ``kept``; false for a null id."""
    left = F.crc32(F.col(id_col).cast("string")) % parts == kept
    return F.coalesce(left, F.lit(False))


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~remainder("doc_id", 4, 2))
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", remainder("doc_id", 4, 2).alias("held_out"), "score", "predicted")


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.where(F.col("doc_id").isNotNull() & ~remainder("doc_id", 3, 1))
    found = language.predict(docs, language.train(known))
    return found.select("doc_id", remainder("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


@query("op4_warc")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    manifest = warc.write_archives(pages, folder)
    records = materialised(warc.read_archives(manifest, folder, with_payload=False))
    # places are unique, so a record is found at the place that the manifest gives its id
    return manifest.join(records, ["archive", "frame", "offset"]).select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(pages.schema["page_id"].dataType).alias("refers_to"),
    )


@query("op5_vector_groups")
def op5_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_groups(table(spark, sf_dir, "embeddings"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op7_token_matrix")
def op7_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack_to_files(table(spark, sf_dir, "documents"), new_folder(spark, "packed"))


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.entity_spans(table(spark, sf_dir, "documents"), kept=["doc_id"])
    base, spans = F.col("base"), F.col("spans")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[pii.kind_count(base, kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.spans_text(base).cast("binary"), 256).alias("base_sha256"),
        pii.spans_text(spans).alias("spans"),
        (F.size(spans) - F.size(base)).cast("bigint").alias("n_added"),
    )


@query("op10_licenses", licenses.rule_sql())
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_matches(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("sentences", "rules", "licenses")])


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a short text of ASCII characters.

    A list of steps is folded into the remainder: bytes are mixed in, ``-1`` shifts by a bit.
    """
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT] || list_value({', '.join(['-1'] * 8)})))"
    bit = "CASE WHEN s >= 0 THEN xor(r, s) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END"
    return f"xor(list_reduce([4294967295::BIGINT] || {steps}, lambda r, s: {bit}), 4294967295)"


OP11_SQL = rf"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS k, digest,
        len(regexp_extract_all(words_of, '[^\x20\x09-\x0D]+')) AS words
    FROM (SELECT conv_id, turn, coalesce(text, '') AS words_of,
        md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT DISTINCT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM turns),
parts AS (
    SELECT c.conv_id, 0 AS own, t.k, t.digest, t.words
    FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.k <= c.h
    UNION ALL SELECT c.conv_id, 1, t.k, t.digest, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h),
seqs AS (
    SELECT conv_id, list(digest ORDER BY own, k) AS ds, list(words ORDER BY own, k) AS ws FROM parts GROUP BY conv_id
    UNION ALL SELECT conv_id, [], [] FROM convs ANTI JOIN parts USING (conv_id)),
steps AS (SELECT conv_id, ds, ws, unnest(range(0, len(ds) + 1)) AS depth FROM seqs),
nodes AS (
    SELECT depth, list_slice(ds, 1, depth) AS key, min(conv_id) AS conv_id, count(*) AS n_convs,
        any_value(CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END) AS words,
        string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(ds) = depth) AS ends
    FROM steps GROUP BY depth, list_slice(ds, 1, depth)),
below AS (SELECT list_slice(key, 1, depth - 1) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
told AS (SELECT n.*, coalesce(b.n_children, 0) AS n_children FROM nodes n LEFT JOIN below b USING (key)),
up AS (
    SELECT list_slice(key, 1, a) AS key, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM told) GROUP BY list_slice(key, 1, a))
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, u.n_leaves,
    CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(t.ends, '')) AS ends_sha256
FROM told t JOIN up u USING (key) LEFT JOIN nodes p ON t.depth > 0 AND p.key = list_slice(t.key, 1, t.depth - 1)
"""


@query("op11_trie", OP11_SQL)
def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.turns_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    conv = F.col("conv_id")
    rows = trie.rebuilt(materialised(turns), conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
    return trie.prefix_trie(rows)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_sql(**found: str) -> str:
    def field(name: str) -> str:
        value = f"CAST({found.get(name, name)} AS VARCHAR)"
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    return f"sha256({' || '.join(map(field, FIELDS))})"


OP12_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, {leaf_sql()} AS leaf,
        CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0
            THEN {leaf_sql(text="replace(text, chr(10), '')")} ELSE {leaf_sql()} END AS claim
    FROM documents),
l AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
up AS (
    SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l
    UNION ALL
    SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
    FROM up WHERE n > 1 GROUP BY tree, level, pos // 3),
sub AS (SELECT tree, max(level) AS levels, arg_max(h, level) AS subroot FROM up GROUP BY tree),
top AS (
    SELECT 0 AS level, tree - 1 AS pos, subroot AS h, count(*) OVER () AS n FROM sub
    UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
    FROM top WHERE n > 1 GROUP BY level, pos // 3),
nodes AS (
    SELECT tree, level, pos, h FROM up
    UNION ALL SELECT 0, level, pos, h FROM top),
beside AS (
    SELECT a.tree, a.level, a.pos,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
    FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 GROUP BY ALL),
root AS (SELECT max(level) AS levels, arg_max(h, level) AS root FROM top),
fold AS (
    SELECT l.doc_id, l.leaf, l.claim, l.tree, l.pos AS first, subroot, root, sub.levels, root.levels AS more,
        0 AS level, l.pos AS pos, l.claim AS node, '' AS proof
    FROM l JOIN sub USING (tree), root
    UNION ALL
    SELECT f.doc_id, leaf, claim, f.tree, first, subroot, root, levels, more, f.level + 1,
        CASE WHEN f.level + 1 = levels THEN f.tree - 1 ELSE f.pos // 3 END,
        sha256(before || node || after), proof || before || after
    FROM (SELECT *, CASE WHEN level < levels THEN tree ELSE 0 END AS t, CASE WHEN level < levels THEN level ELSE level - levels END AS v,
            CASE WHEN levels = 0 AND level = 0 THEN tree - 1 ELSE pos END AS here FROM fold WHERE level < levels + more) f
    JOIN beside b ON b.tree = f.t AND b.level = f.v AND b.pos = f.here)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM fold WHERE level = levels + more
"""


@query("op12_manifest", OP12_SQL)
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(remainder("doc_id", 2, 0), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.dataset_manifest(docs, FIELDS, "doc_id", "source", {"text": tampered})
    found = rows.withColumn("folded_root", merkle.folded(F.col("claim"), F.col("witness")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.proof_text(F.col("witness")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op13_urls")
def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"), urls.labelled_urls(spark), URL_RULES)
