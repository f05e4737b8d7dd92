"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are 64-bit; two link when at most ``radius`` = 4 bits differ. Copies collapse to
one fingerprint first. Six blocks of bits cover a fingerprint: four differences leave at least
two blocks untouched, so linked fingerprints meet under one of the fifteen pairs of blocks.
Buckets that outgrow ``bucket_rows`` are cut into tiles that meet pairwise in tasks of their
own. In a bucket the fingerprints stand as bit planes, one word holding one bit of 64 of
them, and carry-save counters add up the differing bits of 64 comparisons at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.llm.graph import components
from phenoframe.llm.text import map_text, text_bytes
from phenoframe.scale.bounds import materialised

RADIUS = 4
BLOCKS = (11, 11, 11, 11, 10, 10)  # bits, from the lowest
SHINGLE = 4
BUCKET_ROWS = 8192
RUN_LANES = 64  # runs up to here are compared shifted against themselves
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_of(text: bytes, width: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of a text's word shingles, repeats included."""
    words = text.lower().split()  # for bytes: A-Z, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(1, len(words) - width + 1)
    begins = np.concatenate([[0], gaps + 1])[:n].tolist()
    ends = np.concatenate([gaps, [len(joined)]])[min(width, len(words)) - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, n, 65536):
        spans = zip(begins[low : low + 65536], ends[low : low + 65536])
        hashes = np.array([digest(joined[s:e], 42) for s, e in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` per row, ``fp`` the fingerprint's bits as a signed long.

    Null and wordless texts get zero. Every row stays, with repeated or null ids too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = text_bytes(batch.column(1))
            whole = flat.tobytes() if len(flat) <= (64 << 20) else flat
            found = np.zeros(batch.num_rows, np.uint64)
            for i, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                found[i] = fingerprint_of(bytes(whole[s:e]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_text(picked, run, f"doc_id {kind}, fp bigint")


def block_keys(fp: Column) -> Column:
    """The fifteen bucket keys of a fingerprint: number of the pair, then its blocks' bits."""
    parts, low = [], 0
    for bits in BLOCKS:
        parts.append((F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1)), bits))
        low += bits
    keys = []
    for i, ((x, _), (y, bits)) in enumerate(combinations(parts, 2)):
        keys.append(F.shiftleft(F.lit(i).cast("bigint"), 22) + F.shiftleft(x, bits) + y)
    return F.array(*keys)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes ``[64, words]``: bit j of word w of plane b is bit b of fingerprint 64 w + j."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


class Counter:
    """Counts of set bits per lane up to 7 with a sticky overflow, kept in bit planes."""

    def __init__(self, shape):
        self.ones, self.twos, self.fours, self.over = (np.zeros(shape, np.uint64) for _ in range(4))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Add two planes: a carry-save step, then the carry ripples."""
        half = x ^ y
        carry = (x & y) | (half & self.ones)
        self.ones ^= half
        more = self.twos & carry
        self.twos ^= carry
        self.over |= self.fours & more
        self.fours ^= more

    def within(self) -> np.ndarray:
        """Lanes with at most four set bits."""
        return ~(self.over | (self.fours & (self.ones | self.twos)))

    def keep(self, alive: np.ndarray) -> None:
        for name in ("ones", "twos", "fours", "over"):
            setattr(self, name, getattr(self, name)[alive])


def near_lanes(diff, words: int, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and lanes where at most four planes differ.

    ``diff(b, words)`` gives plane b's differing bits at some words. Every eight planes, words
    whose lanes are all beyond the radius are abandoned.
    """
    at, count = np.flatnonzero(mask), None
    lanes = mask[at]
    count = Counter(len(at))
    for b in range(0, 64, 2):
        count.add(diff(b, at), diff(b + 1, at))
        if b % 8 == 6:
            lanes = lanes & count.within()
            alive = lanes != 0
            if not alive.all():
                at, lanes = at[alive], lanes[alive]
                count.keep(alive)
            if not len(at):
                break
    return at, lanes


def lane_numbers(at: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, j = np.nonzero(bits)
    return at[w] * 64 + j


def shifted_pairs(fps: np.ndarray, runs: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (i, j) inside equal ``runs``: the planes are compared with themselves, moved
    by 1, 2, ... lanes, for all runs at once."""
    left, right = [], []
    planes = planes_of(fps)
    n, words = len(fps), planes.shape[1]
    wide = np.concatenate([planes, np.zeros((64, 2), np.uint64)], axis=1)
    for d in range(1, longest):
        same = np.zeros(words * 64, bool)
        same[: n - d] = runs[d:] == runs[:-d]
        mask = np.packbits(same, bitorder="little").view(np.uint64)
        jump, bits = divmod(d, 64)

        def diff(b, at, jump=jump, bits=bits):
            moved = wide[b, at + jump]
            if bits:
                moved = (moved >> np.uint64(bits)) | (wide[b, at + jump + 1] << np.uint64(64 - bits))
            return planes[b, at] ^ moved

        i = lane_numbers(*near_lanes(diff, words, mask))
        left.append(i)
        right.append(i + d)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def block_labels(fps: np.ndarray) -> np.ndarray:
    """Component number of each fingerprint of one large run.

    A frontier of fingerprints is compared with all planes at once; what is near and new
    becomes the next frontier, so each fingerprint is compared once and no pair is kept.
    """
    planes = planes_of(fps)
    words = planes.shape[1]
    fresh = np.zeros(words * 64, bool)
    fresh[: len(fps)] = True
    labels = np.full(len(fps), -1, np.int64)
    step = max(1, (1 << 18) // words)
    for seed in range(len(fps)):
        if labels[seed] >= 0:
            continue
        labels[seed], fresh[seed] = seed, False
        frontier = np.array([seed])
        while len(frontier):
            new = np.zeros(words * 64, bool)
            for low in range(0, len(frontier), step):
                asked = fps[frontier[low : low + step]]
                open_ = np.packbits(fresh & ~new, bitorder="little").view(np.uint64)
                mask = np.tile(open_, len(asked))

                def diff(b, at, asked=asked):
                    set_ = ((asked >> np.uint64(b)) & np.uint64(1)) * ONES
                    return planes[b, at % words] ^ set_[at // words]

                at, lanes = near_lanes(diff, len(mask), mask)
                new[lane_numbers(at % words, lanes)] = True
            frontier = np.flatnonzero(new)
            labels[frontier] = seed
            fresh &= ~new
    return labels


def joined_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n items."""
    labels = np.arange(n)
    while len(left):
        before = labels.copy()
        np.minimum.at(labels, left, labels[right])
        np.minimum.at(labels, right, labels[left])
        labels = labels[labels]
        if (labels == before).all():
            break
    return labels


def run_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, representative) that hold the components of each run of equal keys."""
    if len(keys) < 2:
        return fps[:0], fps[:0]
    change = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(change, len(keys)))
    pairs = [(fps[:0], fps[:0])]
    small = (sizes > 1) & (sizes <= RUN_LANES)
    if small.any():
        picked = np.repeat(small, sizes)
        f, runs = fps[picked], np.repeat(np.arange(len(sizes)), sizes)[picked]
        labels = joined_labels(len(f), *shifted_pairs(f, runs, int(sizes[small].max())))
        moved = labels != np.arange(len(f))
        pairs.append((f[moved], f[labels[moved]]))
    for run in np.flatnonzero(sizes > RUN_LANES):
        f = fps[change[run] : change[run] + sizes[run]]
        labels = block_labels(f)
        moved = labels != np.arange(len(f))
        pairs.append((f[moved], f[labels[moved]]))
    return tuple(np.concatenate(x) for x in zip(*pairs))


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by key; a run may go on in the next batch."""
    names = ["fp", "other"]
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def out(k, f):
        a, b = run_links(k, f)
        arrays = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        keys = np.concatenate([keys, np.asarray(batch.column(0))])
        fps = np.concatenate([fps, np.asarray(batch.column(1)).view(np.uint64)])
        done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if done:
            yield out(keys[:done], fps[:done])
            keys, fps = keys[done:], fps[done:]
    yield out(keys, fps)


def fingerprint_links(distinct: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``(fp, other)`` whose components are those of all pairs within the radius.

    ``distinct`` holds each fingerprint once in ``fp``. The keys of a tile of a large bucket
    are hashes of bucket and tile pair, so a task gets at most two tiles of it.
    """
    keyed = distinct.select(F.explode(block_keys(F.col("fp"))).alias("key"), "fp")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = materialised(
        sizes.where(F.col("n") > bucket_rows).select(
            F.col("key").alias("bucket"), F.ceil(F.col("n") / bucket_rows).cast("int").alias("tiles")
        )
    )
    cold = keyed
    if not large.isEmpty():
        marked = keyed.join(large, keyed["key"] == large["bucket"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        others = F.transform(
            F.sequence(F.lit(0), F.col("tiles") - 1),
            lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)),
        )
        spread = F.when(F.col("tiles").isNull(), F.array("key")).otherwise(others)
        cold = marked.select(F.explode(spread).alias("key"), "fp")
    return cold.repartition("key").sortWithinPartitions("key").mapInArrow(
        compared, "fp bigint, other bigint"
    )


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``.

    ``component_id`` is the smallest id reachable by links, its own included. Rows with equal
    ids or texts all stay; a null id never becomes a component's name unless all are null.
    Null, empty and wordless texts share fingerprint zero and link like any other. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    marked = materialised(fingerprints(docs, id_col, text_col))
    distinct = materialised(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    groups = components(fingerprint_links(distinct.select("fp"), bucket_rows), "fp", "other")
    named = distinct.join(groups, distinct["fp"] == groups["node"], "left").select(
        "fp", "least_id", F.coalesce("label", "fp").alias("label")
    )
    least = materialised(named.groupBy("label").agg(F.min("least_id").alias("component_id")))
    names = materialised(named.join(least, "label").select(F.col("fp").alias("_fp"), "component_id"))
    return marked.join(names, marked["fp"] == names["_fp"]).select("doc_id", "fp", "component_id")
