"""Document quality by Bradley-Terry ranking of preference pairs.

Each labelled document is described by scale-free measures of its whole text. A preferred
(label 1) document beats a rejected (label 0) one with probability sigmoid(w (x - y)); the
weights are fitted by logistic loss on such feature differences, in Newton steps whose sums the
tasks take over all labelled rows. The score quantile that equals the share of rejected documents becomes the threshold, and scores are shifted so that
the threshold stands at ``at``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.llm.text import LOWER, lookup, map_text, slices, text_bytes, word_hashes, word_spans
from phenoframe.scale.bounds import materialised
from phenoframe.scale.ranks import sequential_id

CLASSES = [
    ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("digit", b"0123456789"),
    ("space", b" \t\r\v\f"),
    ("newline", b"\n"),
    ("stop", b".,;:?'\""),
    ("bang", b"!"),
    ("hash", b"#"),
    ("star", b"*"),
    ("percent", b"%"),
    ("ampersand", b"&"),
    ("dollar", b"$"),
    ("bar", b"|"),
    ("brackets", b"()[]{}<>"),
    ("other", bytes(set(range(33, 127)) - set(b"!#*%&$|()[]{}<>.,;:?'\"") - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)))),
    ("control", bytes(set(range(32)) - set(b" \t\r\v\f\n")) + b"\x7f"),
]
WORD_MEASURES = ["repeated", "distinct", "distinct_pairs", "word_length", "long_words", "size"]
FEATURES = [name for name, _ in CLASSES] + WORD_MEASURES
CODE = np.zeros(256, np.int64)
for _i, (_, _members) in enumerate(CLASSES):
    CODE[list(_members)] = _i + 1
NOT_SPACE = ~lookup(b" \t\n\r\v\f\x00")
PARTNERS = 6  # preference pairs per row of the rarer label, at least


def distinct_share(keys: np.ndarray, rows: np.ndarray, n: int, counts: np.ndarray) -> np.ndarray:
    """Share of different keys per row."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n) / np.maximum(counts, 1)


def measures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The features of some rows' texts, one row each."""
    n, size = len(starts) - 1, np.diff(starts)
    if not len(flat):
        return np.zeros((n, len(FEATURES)))
    kinds = len(CLASSES) + 1
    row = np.repeat(np.arange(n), size)
    shares = np.bincount(row * kinds + CODE[flat], minlength=n * kinds).reshape(n, kinds)[:, 1:]
    shares = np.sqrt(shares / np.maximum(size, 1)[:, None])
    low = LOWER[flat]
    begins, ends, first = word_spans(low, starts, NOT_SPACE)
    words = np.diff(first)
    hashes = word_hashes(low, begins, ends)
    of = np.repeat(np.arange(n), words)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    pair = hashes * np.uint64(3)
    pair[1:] += hashes[:-1]
    width = ends - begins
    some = np.maximum(words, 1)
    extra = [
        np.bincount(of, same, minlength=n) / some,
        distinct_share(hashes, of, n, words),
        distinct_share(pair, of, n, words),
        np.bincount(of, np.minimum(width, 50), minlength=n) / some / 10,
        np.bincount(of, width > 20, minlength=n) / some,
        np.log1p(words) / 10,
    ]
    return np.column_stack([shares, *extra])


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, features)`` of whole texts; null and empty texts have features of zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = text_bytes(batch.column(1))
            for low, high in slices(starts):
                part = measures(flat[starts[low] : starts[high]], starts[low : high + 1] - starts[low])
                features = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(FEATURES)), pa.array(part.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], features], ["doc_id", "features"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_text(picked, run, f"doc_id {kind}, features array<double>")


@dataclass
class Ranking:
    """Score of features x: sigmoid(slope * (w x) + shift)."""

    weights: list[float]
    shift: float

    def total(self, features: Column) -> Column:
        terms = [F.get(features, F.lit(i)) * F.lit(float(w)) for i, w in enumerate(self.weights)]
        total = F.lit(self.shift)
        for term in terms:
            total = total + term
        return total

    def score(self, features: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.total(features)))


def pair_sums(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed gradient and Hessian of the loss over pair differences."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
    return d.T @ (p - 1), (d * (p * (1 - p))[:, None]).T @ d


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, width: int, penalty: float) -> np.ndarray:
    """Weights of least loss over ``n`` pairs, given the sums of :func:`pair_sums` over all of them."""
    w = np.zeros(width)
    for _ in range(25):
        slope, bend = sums(w)
        step = np.linalg.solve(bend / n + penalty * np.eye(width), slope / n + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def one_sided(n_good: int, n_bad: int, width: int, at: float) -> Ranking:
    """With one label only, every score is ``at`` or just below it."""
    edge = float(np.log(at / (1 - at)))
    return Ranking([0.0] * width, edge + (1e-6 if n_good or not n_bad else -1e-6))


def fit_ranking(x: np.ndarray, y: np.ndarray, at: float = 0.7, penalty: float = 1e-3) -> Ranking:
    """Bradley-Terry weights by Newton steps on pair differences of rows in memory.

    Each row of the rarer label meets partners of the other label, dealt in turn, so that all
    rows take part. :func:`fit_rows` does the same for rows of any number.
    """
    good, bad = x[y == 1], x[y == 0]
    edge = float(np.log(at / (1 - at)))
    if not len(good) or not len(bad):
        return one_sided(len(good), len(bad), x.shape[1], at)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    g, b = (good - centre) / spread, (bad - centre) / spread
    n = max(len(g), len(b), PARTNERS * min(len(g), len(b)))
    turn = np.arange(n)
    few = min(len(g), len(b))  # each lap over the rarer label meets the other one step further
    lap = turn // few
    d = g[(turn + lap * (few == len(b))) % len(g)] - b[(turn + lap * (few < len(b))) % len(b)]
    w = newton(lambda w: pair_sums(d, w), n, x.shape[1], penalty)
    s = np.sort(np.concatenate([g @ w, b @ w]))
    cut = len(b)  # the quantile at the share of rejected rows
    threshold = (s[max(cut - 1, 0)] + s[min(cut, len(s) - 1)]) / 2
    w = w / spread
    return Ranking(w.tolist(), float(edge - threshold - w @ centre))


def labelled_rows(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """All ids with one label, 0 or 1; contradicting rows are left out."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    agreed = one.groupBy(F.col(id_col).alias("_id")).agg(
        F.min(label_col).alias("_y"), F.max(label_col).alias("_z")
    )
    return agreed.where("_y = _z").select("_id", F.col("_y").cast("int").alias("_y")).where("_y in (0, 1)")


def spread_sums(pairs: DataFrame) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """:func:`pair_sums` over a written table of differences: tasks add up, the driver gets one row of each."""

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slope, bend = np.zeros(len(w)), np.zeros((len(w), len(w)))
            for batch in batches:
                d = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(w))
                part = pair_sums(d, w)
                slope, bend = slope + part[0], bend + part[1]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([slope, bend.ravel()])])], ["sums"])

        rows = pairs.mapInArrow(run, "sums array<double>").toArrow().column("sums").combine_chunks()
        total = rows.flatten().to_numpy().reshape(-1, len(w) * (len(w) + 1)).sum(axis=0)
        return total[: len(w)], total[len(w) :].reshape(len(w), len(w))

    return sums


def fit_rows(known: DataFrame, at: float, penalty: float = 1e-3) -> Ranking:
    """The ranking of :func:`fit_ranking` over a table ``(_id, features, _y)`` of any size.

    Rows are numbered per label in hash order and joined to their partners by number; the threshold
    is the exact quantile of all scores. Of rows with one id the one with the least features counts.
    """
    spark, width = known.sparkSession, len(FEATURES)
    one = known.groupBy("_id").agg(F.min(F.struct("features", "_y")).alias("_r"))
    one = one.select("_id", F.xxhash64("_id").alias("_h"), "_r.features", "_r._y")
    rows = materialised(sequential_id(one, ["_y", "_h", "_id"], "_at"))  # rejected rows come first
    value = [F.get("features", F.lit(i)) for i in range(width)]
    found = rows.agg(
        F.count_if(F.col("_y") == 0).alias("bad"), F.count_if(F.col("_y") == 1).alias("good"),
        F.array(*[F.avg(v) for v in value]).alias("centre"), F.array(*[F.stddev_pop(v) for v in value]).alias("spread"),
    ).first()
    bad, good = found["bad"], found["good"]
    if not good or not bad:
        return one_sided(good, bad, width, at)
    centre, spread = np.array(found["centre"]), np.array(found["spread"]) + 1e-3
    few, n = min(good, bad), max(good, bad, PARTNERS * min(good, bad))
    lap = F.floor(F.col("id") / few)  # each lap over the rarer label meets the other one step further
    turns = spark.range(n).select(
        ((F.col("id") + (lap if few == bad else 0)) % good + bad).alias("_g"),
        ((F.col("id") + (lap if few < bad else 0)) % bad).alias("_b"),
    )
    over = F.array(*[F.lit(float(v)) for v in spread])
    gap = F.zip_with(F.zip_with("_x", "_z", lambda a, b: a - b), over, lambda d, v: d / v)
    pairs = turns.join(rows.select(F.col("_at").alias("_g"), F.col("features").alias("_x")), "_g").join(
        rows.select(F.col("_at").alias("_b"), F.col("features").alias("_z")), "_b"
    )
    w = newton(spread_sums(materialised(pairs.select(gap.alias("d")))), n, width, penalty) / spread
    plain = Ranking(w.tolist(), float(-(w @ centre)))
    ends = sequential_id(rows.select(plain.total(F.col("features")).alias("_s")), ["_s"], "_at")
    low, high = sorted(r["_s"] for r in ends.where(F.col("_at").isin(bad - 1, bad)).collect())
    return Ranking(plain.weights, float(np.log(at / (1 - at))) - (low + high) / 2 + plain.shift)


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    at: float = 0.7,
) -> DataFrame:
    """The rows of ``docs`` that score ``at`` or more, with all their columns.

    Texts pass through the tasks that measure them, once for the fit and once to be scored; only
    ids, labels and features are shuffled. Without both labels
    nothing is rejected, unless only rejected rows are known.
    """
    features = text_features(docs, id_col, text_col)
    agreed = labelled_rows(labels, id_col, label_col)
    ranking = fit_rows(features.join(agreed, F.col("doc_id") == F.col("_id")).select("_id", "features", "_y"), at)
    weights, shift, edge = np.array(ranking.weights), ranking.shift, float(np.log(at / (1 - at)))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = text_bytes(batch.column(place))
            for low, high in slices(starts):
                x = measures(flat[starts[low] : starts[high]], starts[low : high + 1] - starts[low])
                good = x @ weights + shift >= edge
                yield batch.slice(low, high - low).filter(pa.array(good))

    return map_text(docs, run, docs.schema)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    at: float = 0.7,
) -> DataFrame:
    """``(doc_id, score, predicted)`` per row of ``docs``; ``predicted`` is 1 from ``at`` on.

    ``labels`` holds the rows to learn from (its id column is named like that of ``docs``);
    all of them fit the weights. Null and empty texts are scored like any
    other, repeated rows and null ids stay, other columns are ignored. Without both labels all
    scores are ``at``, or just below it if only rejected rows are known.
    """
    features = materialised(text_features(docs, id_col, text_col))
    agreed = labelled_rows(labels, id_col, label_col)
    ranking = fit_rows(features.join(agreed, F.col("doc_id") == F.col("_id")).select("_id", "features", "_y"), at)
    scored = features.select("doc_id", ranking.score(F.col("features")).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= at).cast("int").alias("predicted"))
