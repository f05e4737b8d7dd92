"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every run of other characters than letters becomes one space.
N-grams of code points are hashed to a fixed number of buckets; training counts buckets per
language over all training rows, and scoring multiplies each text's sparse bucket counts with
the broadcast matrix of log-probabilities.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoframe.llm.places import numbered
from phenoframe.llm.text import map_text, mix, slices, text_bytes
from phenoframe.scale.bounds import materialised

BITS = 16
ORDERS = (1, 2, 3)
CHUNK = 256  # languages scored at once; bounds the matrix that is broadcast: 256 x 2**16 x 4 bytes
COUNTED = 32  # languages counted at once in a task
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def clean_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts, each between spaces, and where each one starts.

    A text without letters is empty.
    """
    lowered = [t.lower() for t in texts]
    size = np.array([len(t) + 1 for t in lowered], np.int64)
    points = np.frombuffer((" ".join([*lowered, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(size)])
    is_letter = letters()[points]
    before = np.zeros(len(points), bool)
    before[1:] = is_letter[:-1]
    before[starts[:-1]] = False
    keep = is_letter | before
    kept = np.where(is_letter, points, 32)[keep]
    moved = np.concatenate([[0], np.cumsum(keep)])[starts]
    return kept.astype(np.uint64), moved


def grams(points: np.ndarray, starts: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of one order and where each text's begin."""
    n = len(points) - order + 1
    size = np.maximum(np.diff(starts) - order + 1, 0)
    if n <= 0:
        return np.empty(0, np.int64), np.zeros(len(starts), np.int64)
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h = h * np.uint64(0x100000001B3) + points[k : k + n]
    bucket = (mix(h) >> np.uint64(64 - bits)).astype(np.int64)
    if order > 1:  # not across texts
        inside = np.ones(n, bool)
        for k in range(1, order):
            edge = starts[1:-1] - k
            inside[edge[(edge >= 0) & (edge < n)]] = False
        bucket = bucket[inside]
    return bucket, np.concatenate([[0], np.cumsum(size)])


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of about one slice of text."""
    _, starts = text_bytes(column)
    for low, high in slices(starts):
        yield low, high, [t or "" for t in column[low:high].to_pylist()]


def count_grams(
    docs: DataFrame, text_col: str, lang_col: str, orders=ORDERS, bits: int = BITS
) -> DataFrame:
    """``(lang, bucket, n)`` over all rows with text and language; bucket -1 counts rows.

    Tasks count into arrays and emit what is not zero; Spark adds the partial counts up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def emit():
            for lang, row in counts.items():
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([lang] * len(at), pa.string()),
                        "bucket": pa.array((at - 1).astype(np.int32)),
                        "n": pa.array(row[at]),
                    }
                )
            counts.clear()

        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            names, code = langs.dictionary.to_pylist(), np.asarray(langs.indices)
            for low, high, texts in texts_of(batch.column(0)):
                points, starts = clean_points(texts)
                row_lang = code[low:high]
                found = [grams(points, starts, order, bits) for order in orders]
                present = np.unique(row_lang).tolist()
                for first in range(0, len(present), COUNTED):
                    some = present[first : first + COUNTED]
                    if len(counts.keys() | {names[which] for which in some}) > COUNTED:
                        yield from emit()
                    for which in some:
                        row = counts.setdefault(names[which], np.zeros((1 << bits) + 1, np.int64))
                        row[0] += int((row_lang == which).sum())
                        for bucket, begin in found:
                            own = np.repeat(row_lang == which, np.diff(begin))
                            row[1:] += np.bincount(bucket[own], minlength=1 << bits)
        yield from emit()

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    picked = known.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    parts = map_text(picked, run, "lang string, bucket int, n bigint")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def language_table(counts: DataFrame, bits: int = BITS, smoothing: float = 0.5, chunk: int = CHUNK) -> DataFrame:
    """``(chunk, lang, rows, logs)``: a row of log-probabilities per language, in order of names.

    A language's counts, one per bucket at most, meet in a task; nothing reaches the driver.
    """

    def run(table: pa.Table) -> pa.Table:
        row = np.zeros((1 << bits) + 1)
        row[table.column("bucket").to_numpy() + 1] = table.column("n").to_numpy()
        grams_ = row[1:] + smoothing
        logs = np.log(grams_ / grams_.sum()).astype(np.float32)
        return pa.table({"lang": table.column("lang").slice(0, 1), "rows": [int(row[0])], "logs": pa.array([logs.tobytes()], pa.binary())})

    rows = materialised(counts.groupBy("lang").applyInArrow(run, "lang string, rows bigint, logs binary"))
    names = numbered(materialised(rows.select(F.lit("").alias("all"), "lang")), ["all"], ["lang"])
    names = names.select(F.floor(F.col("_at") / F.lit(chunk)).cast("int").alias("chunk"), F.col("lang").alias("_lang"))
    return materialised(rows.join(names, F.col("lang") == F.col("_lang")).drop("_lang"))


class NaiveBayes:
    """At most ``CHUNK`` languages in order, log priors and a ``[bucket, language]`` matrix."""

    def __init__(self, part: list, total: int):
        part = sorted(part, key=lambda r: r["lang"])
        self.languages = [r["lang"] for r in part]
        self.prior = np.log(np.array([r["rows"] for r in part]) / max(1, total))
        self.matrix = np.stack([np.frombuffer(r["logs"], np.float32) for r in part]).T.copy() if part else None

    def posterior(self, texts: list[str], orders=ORDERS, bits: int = BITS):
        """Log-posteriors up to a constant, and which texts have letters."""
        points, starts = clean_points(texts)
        total = np.tile(self.prior, (len(texts), 1))
        for order in orders:
            bucket, begin = grams(points, starts, order, bits)
            full = np.flatnonzero(np.diff(begin))
            if len(full):
                for lang in range(len(self.languages)):
                    values = self.matrix[:, lang][bucket].astype(np.float64)
                    total[full, lang] += np.add.reduceat(values, begin[full])
        return total, np.diff(starts) > 0


class Model:
    """A written table of languages, scored ``chunk`` by ``chunk``."""

    def __init__(self, table: DataFrame):
        self.table = table
        known = table.agg(F.max("chunk").alias("last"), F.sum("rows").alias("rows")).first()
        self.chunks = 0 if known["last"] is None else known["last"] + 1
        self.total = known["rows"] or 0

    def part(self, chunk: int) -> NaiveBayes:
        return NaiveBayes(self.table.where(F.col("chunk") == chunk).collect(), self.total)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", chunk: int = CHUNK) -> Model:
    """Fit on all rows with text and language, any number of languages."""
    return Model(language_table(count_grams(docs, text_col, lang_col), chunk=chunk))


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row; ``score`` is the language's posterior.

    Null texts and texts without a letter are ``und`` with score 0, as is everything when no
    language was learned. Of equal languages the first in order wins. Repeated rows and null
    ids stay. Each chunk of languages is a pass of its own over the rows, which carry the best
    language so far, its log-posterior and the sum of all posteriors in units of it.
    """
    context = docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not model.chunks:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def scored(sent, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = sent.value
            names = np.array(part.languages, object)
            for batch in batches:
                for low, high, texts in texts_of(batch.column(1)):
                    total, lettered = part.posterior(texts)
                    best, top = names[total.argmax(axis=1)], total.max(axis=1)
                    mass = np.exp(total - top[:, None]).sum(axis=1)
                    if not first:
                        before = [np.asarray(batch.column(c)[low:high].to_pylist()) for c in ("best", "top", "mass")]
                        best = np.where(top > before[1], best, before[0].astype(object))
                        most = np.maximum(top, before[1])
                        mass = mass * np.exp(top - most) + before[2] * np.exp(before[1] - most)
                        top = most
                    own = [batch.column(0)[low:high]]
                    if last:
                        found = [pa.array(np.where(lettered, best, UNKNOWN), pa.string()), pa.array(np.where(lettered, 1 / mass, 0.0))]
                        yield pa.RecordBatch.from_arrays(own + found, ["doc_id", "lang_pred", "score"])
                    else:
                        found = [batch.column(1)[low:high], pa.array(best, pa.string()), pa.array(top), pa.array(mass)]
                        yield pa.RecordBatch.from_arrays(own + found, ["doc_id", "text", "best", "top", "mass"])

        return run

    for chunk in range(model.chunks):
        last = chunk == model.chunks - 1
        out = "lang_pred string, score double" if last else "text string, best string, top double, mass double"
        rows = map_text(rows, scored(context.broadcast(model.part(chunk)), chunk == 0, last), f"doc_id {kind}, {out}")
    return rows
