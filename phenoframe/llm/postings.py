"""Benchmark decontamination over a distributed positional inverted index.

The index is a written table of blocks. A block holds the documents of one slice of one
task: their ids and lengths, its sorted terms (64-bit word hashes) and, per term, the sorted
positions of the term in the block's run of words. Phrases are looked up block by block:
the shortest position list of a phrase gives candidate starts, which are intersected with the
lists of its other terms, each moved by the term's offset, from the rarest to the commonest.
All phrases of a chunk go through these steps together. With a slop the moved lists may miss
by that many words, which gives proximity matches.

Words are lower-case (A-Z only) runs of digits, letters a-z and all characters beyond ASCII.
Terms are compared by hash, so a wrong match needs a 64-bit collision with a phrase's word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from phenoframe.llm.text import LOWER, lookup, map_text, ranges, slices, text_bytes, word_hashes, word_spans
from phenoframe.scale.bounds import materialised

WINDOW = 10
CHUNK_BYTES = 1 << 20  # phrase text sent to the tasks at once; more phrases take more passes
WORD_BYTES = lookup(bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def term_stream(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all words of some rows, and each row's first word."""
    low = LOWER[flat]
    begins, ends, first = word_spans(low, starts, WORD_BYTES)
    return word_hashes(low, begins, ends), first


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Write the index of whole texts, to ``folder`` if one is named, and return it, one row per block.

    Null texts are documents without words; repeated and null ids stay apart as documents.
    Blocks follow the scan, so nothing is shuffled and no key can grow hot.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = picked.limit(0).toArrow().schema.field("doc_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            flat, starts = text_bytes(batch.column(1))
            for low, high in slices(starts):
                part = flat[starts[low] : starts[high]]
                hashes, first = term_stream(part, starts[low : high + 1] - starts[low])
                order = np.argsort(hashes, kind="stable")
                ranked = hashes[order]
                change = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                change = change[: len(ranked)]
                counts = np.diff(np.append(change, len(ranked))).astype(np.int32)
                row = {
                    "block": pa.array([block], pa.int64()),
                    "ids": pa.array([batch.column(0)[low:high].to_pylist()], pa.list_(id_type)),
                    "n_words": pa.array([np.diff(first).astype(np.int32)], pa.list_(pa.int32())),
                    "terms": pa.array([ranked[change].tobytes()], pa.binary()),
                    "counts": pa.array([counts.tobytes()], pa.binary()),
                    "positions": pa.array([order.astype(np.int32).tobytes()], pa.binary()),
                }
                block += 1
                yield pa.RecordBatch.from_pydict(row)

    schema = (
        f"block bigint, ids array<{kind}>, n_words array<int>, terms binary, counts binary, "
        "positions binary"
    )
    return materialised(map_text(picked, run, schema), folder)


def index_documents(index: DataFrame) -> DataFrame:
    """``(block, ordinal, doc_id, n_words)`` of every indexed document."""
    pairs = F.posexplode(F.arrays_zip("ids", "n_words")).alias("ordinal", "d")
    return index.select("block", pairs).select(
        "block", "ordinal", F.col("d.ids").alias("doc_id"), F.col("d.n_words").cast("bigint").alias("n_words")
    )


CANDIDATES = 1 << 20  # places tried at once; a window with more in a block is tried alone


class Phrases:
    """Different windows of ``width`` words over items; a shorter item is one window.

    Windows with the same words are searched once; ``item[of[w] : of[w + 1]]`` are the items that hold
    window ``w``.
    """

    def __init__(self, texts: pa.Array, width: int):
        flat, starts = text_bytes(texts)
        hashes, first = term_stream(flat, starts)
        self.terms, words = np.unique(hashes, return_inverse=True)
        n = np.diff(first)
        windows = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
        item = np.repeat(np.arange(len(n)), windows)
        length = np.minimum(n, width)[item]
        places = np.arange(int(length.max(initial=0)))
        at = ranges(first[:-1], windows)[:, None] + places[None, :]
        used = places[None, :] < length[:, None]
        every = np.where(used, words[np.minimum(at, max(0, len(words) - 1))] if len(words) else 0, -1)
        self.words, which = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, item)
        self.length = (self.words >= 0).sum(axis=1)
        held = np.unique(np.stack([which.reshape(-1), item], axis=1), axis=0)
        self.item, self.of = held[:, 1], np.searchsorted(held[:, 0], np.arange(len(self.words) + 1))

    def holders(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each window's items, and the places of the windows they are of."""
        size = self.of[window + 1] - self.of[window]
        return self.item[ranges(self.of[window], size)], np.repeat(np.arange(len(window)), size)


def united(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the joined spans of each group begin and how they end, for spans sorted by start."""
    if not len(start):
        return np.empty(0, np.int64), end
    other = np.concatenate([[False], group[1:] != group[:-1]])
    lift = np.cumsum(other) * (int(end.max()) - int(min(0, end.min())) + 1)
    reach = np.maximum.accumulate(end + lift) - lift  # the greatest end so far in the group
    at = np.flatnonzero(np.concatenate([[True], other[1:] | (start[1:] > reach[:-1])]))
    return at, reach[np.append(at[1:], len(start)) - 1]


def search(phrases: Phrases, terms, counts, positions, first, slop: int):
    """Windows, starts and documents of a block's matches."""
    none = np.empty(0, np.int64)
    if not len(terms) or not len(phrases.words):
        return none, none, none
    at = np.minimum(np.searchsorted(terms, phrases.terms), len(terms) - 1)
    known = terms[at] == phrases.terms
    size = np.where(known, counts[at], 0)
    begin = (np.cumsum(counts) - counts)[at]
    # One sorted list of (term, position) stands for the lists of all phrase terms.
    lists = positions[ranges(begin, size)].astype(np.int64)
    lists += np.repeat(np.arange(len(size)), size) << 32
    lists_begin = np.cumsum(size) - size

    length = np.where(phrases.words < 0, np.iinfo(np.int64).max, size[phrases.words])
    window = np.flatnonzero(length.min(axis=1) > 0)
    order = np.argsort(length[window], axis=1, kind="stable")
    word = np.take_along_axis(phrases.words[window], order, axis=1)
    every = np.cumsum(size[word[:, 0]]) if len(window) else none
    found, low = [], 0
    while low < len(window):
        reached = every[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(every, reached + CANDIDATES, side="right")))
        some = slice(low, high)
        found.append(candidates(window[some], order[some], word[some], size, lists, lists_begin, first, slop))
        low = high
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (none, none, none)


def candidates(window, order, word, size, lists, lists_begin, first, slop: int):
    """Matches of some windows: places of the rarest word at which all others stand."""
    anchor = word[:, 0]
    n = size[anchor]
    start = (lists[ranges(lists_begin[anchor], n)] & 0xFFFFFFFF) - np.repeat(order[:, 0], n)
    row = np.repeat(np.arange(len(window)), n)
    # the anchor's document; the others must lie in it as well
    doc = np.searchsorted(first, start + order[row, 0], side="right") - 1
    for k in range(1, word.shape[1]):
        term, place = word[row, k], order[row, k]
        due = start + place
        low = np.maximum(due - slop, first[doc])
        high = np.minimum(due + slop, first[doc + 1] - 1)
        base = term.astype(np.int64) << 32
        found = np.searchsorted(lists, base + low)
        found = np.minimum(found, len(lists) - 1)
        here = (lists[found] >= base + low) & (lists[found] <= base + high) & (low <= high)
        keep = here | (term < 0)
        row, start, doc = row[keep], start[keep], doc[keep]
    return window[row], start, doc


def phrase_matches(
    index: DataFrame,
    items: DataFrame,
    item_col: str = "item_id",
    text_col: str = "text",
    width: int = WINDOW,
    slop: int = 0,
    chunk_bytes: int = CHUNK_BYTES,
    merged: bool = False,
) -> DataFrame:
    """``(block, ordinal, doc_id, item_id, length, starts)``: where windows of items occur.

    A window is ``width`` consecutive words of an item, or a whole shorter item; ``starts``
    are the places of its occurrences in the document, counted in words. With ``slop`` each
    word may stand up to that many words off its place relative to the window's rarest word
    (a start before the document's first word is then negative). Items without words match
    nothing. Items go to the tasks in chunks of about ``chunk_bytes`` of text, one pass over
    the index per chunk, so their number is not limited. With ``merged`` the occurrences of an
    item that touch are one: ``starts`` are the places where they begin and ``ends`` where they end.
    """
    spark = index.sparkSession
    named = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    named = materialised(named.withColumn("row", F.monotonically_increasing_id()))  # equal rows differ
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = -(-total // chunk_bytes)
    chunk = F.pmod(F.xxhash64("row"), F.lit(max(1, chunks)))
    id_kind = index.schema["ids"].dataType.elementType.simpleString()
    item_kind = named.schema["item_id"].dataType.simpleString()
    schema = (
        f"block bigint, ordinal int, doc_id {id_kind}, item_id {item_kind}, length int, "
        "starts array<int>" + ", ends array<int>" * merged
    )
    parts = []
    for k in range(chunks):
        rows = named.where(chunk == k).drop("row").toArrow()
        sent = spark.sparkContext.broadcast(rows.combine_chunks())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = sent.value
            texts = table.column("text").combine_chunks()
            names = table.column("item_id").combine_chunks()
            texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
            phrases = Phrases(texts, width)
            for batch in batches:
                for i in range(batch.num_rows):
                    lengths = batch.column("n_words")[i].values.to_numpy(zero_copy_only=False)
                    first = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                    raw = {c: batch.column(c)[i].as_buffer() for c in ("terms", "counts", "positions")}
                    window, start, doc = search(
                        phrases,
                        np.frombuffer(raw["terms"], np.uint64),
                        np.frombuffer(raw["counts"], np.int32).astype(np.int64),
                        np.frombuffer(raw["positions"], np.int32),
                        first,
                        slop,
                    )
                    start = start - first[doc]
                    if merged:  # repeated words first, before windows become items
                        order = np.lexsort((start, window, doc))
                        doc, window, start = doc[order], window[order], start[order]
                        at, end = united(doc * len(phrases.words) + window, start, start + phrases.length[window])
                        doc, window, start = doc[at], window[at], start[at]
                    else:
                        end = start + phrases.length[window]
                    item, of = phrases.holders(window)
                    doc, window, start, end = doc[of], window[of], start[of], end[of]
                    order = np.lexsort((start, item, doc))
                    doc, item, start, end, window = doc[order], item[order], start[order], end[order], window[order]
                    if merged:
                        at, end = united(doc * len(names) + item, start, end)
                        doc, item, start, window = doc[at], item[at], start[at], window[at]
                    change = np.ones(len(doc), bool)
                    change[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
                    change = np.flatnonzero(change)
                    ids = batch.column("ids")[i].values
                    cuts = pa.array(np.append(change, len(doc)).astype(np.int32))
                    row = {
                        "block": pa.array(np.full(len(change), batch.column("block")[i].as_py())),
                        "ordinal": pa.array(doc[change].astype(np.int32)),
                        "doc_id": ids.take(pa.array(doc[change])),
                        "item_id": names.take(pa.array(item[change])),
                        "length": pa.array(phrases.length[window[change]].astype(np.int32)),
                        "starts": pa.ListArray.from_arrays(cuts, pa.array(start.astype(np.int32))),
                    }
                    if merged:
                        row["ends"] = pa.ListArray.from_arrays(cuts, pa.array(end.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(row)

        parts.append(map_text(index, run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    matches = parts[0]
    for part in parts[1:]:
        matches = matches.union(part)
    return matches


def covered(spans: Column) -> Column:
    """Number of positions inside any of an array of (start, end) spans."""
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to"))

    def add(acc, s):
        new = F.greatest(F.lit(0), s["e"] - F.greatest(s["s"], acc["to"])).cast("bigint")
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["to"], s["e"]).alias("to"))

    return F.aggregate(F.array_sort(spans), state, add)["n"]


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    folder: str | None = None,
) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, contaminated)`` per document.

    ``n_hit`` counts words inside any occurrence of an item's window, ``items`` are the
    distinct ids of items with occurring windows, sorted as strings (an item without id hits
    words but is not listed). Null and empty texts have no words, an item without words has
    no window; without items nothing is hit. Repeated rows and ids give one row each; other
    columns of either table are ignored. The index goes to ``folder`` if one is named; the
    result reads it until it has been written itself.
    """
    index = build_index(docs, id_col, text_col, folder)
    matches = phrase_matches(index, items, item_col, item_text_col, width, merged=True)
    spans = F.zip_with("starts", "ends", lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    found = (
        matches.select("block", "ordinal", F.col("item_id").cast("string").alias("item"), spans.alias("spans"))
        .groupBy("block", "ordinal")
        .agg(F.array_sort(F.collect_set("item")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
        .select("block", "ordinal", "items", covered(F.col("spans")).alias("n_hit"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return index_documents(index).join(found, ["block", "ordinal"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (n_hit > 0).alias("contaminated"),
    )
