"""Packed token matrices by best-fit-decreasing with a segment tree over free room.

Each task cuts its documents into pieces of at most one sequence, sorts the pieces of a batch
of sequences by falling length, and puts each into the fullest open sequence that still has
room. A segment tree over the rooms 0..length finds that sequence in logarithmic time. The
packed batch is written as binary files: a matrix of ids, a matrix of position ids that
restart with every piece, and the cumulative piece lengths of every row.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoframe.llm.files import attempt_name, located, write_file
from phenoframe.llm.text import map_text, slices, text_bytes
from phenoframe.llm.tokens import SLICE_BYTES, encoder
from phenoframe.scale.bounds import materialised

LENGTH = 2048
END = 1
BATCH_TOKENS = 4 << 20  # ids packed at once, some 2,000 sequences


class RoomTree:
    """Counts of open bins per free room; finds the least room that is large enough."""

    def __init__(self, rooms: int):
        self.size = 1 << rooms.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def least_from(self, room: int) -> int:
        """The smallest room of at least ``room`` with an open bin, or -1."""
        i = room + self.size
        if self.tree[i]:
            return room
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """Bin of each piece by best-fit-decreasing; equal pieces keep their order."""
    tree, open_bins = RoomTree(length), [[] for _ in range(length + 1)]
    bins, n = np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room = tree.least_from(size)
        if room < 0:
            room, b, n = length, n, n + 1
        else:
            b = open_bins[room].pop()
            tree.add(room, -1)
        bins[i] = b
        if room > size:
            open_bins[room - size].append(b)
            tree.add(room - size, 1)
    return bins


def as_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def pack_to_files(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END,
    pad_id: int = 0,
    tokenizer: str | None = None,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """Pack all documents into files in ``folder`` and return the manifest, one row per sequence.

    ``(file, row, n_tokens, ids_crc32, cu_seqlens, doc_ids, starts)``: row ``row`` of
    ``<file>.ids.npy`` holds the padded ids and of ``<file>.positions.npy`` the position ids;
    ``<file>.lengths.npy`` holds all rows' ``cu_seqlens`` in order. ``starts`` are the ids of
    each document before its piece. Documents longer than a sequence are split without loss.
    Null and empty texts are the end mark alone; repeated rows are packed each for itself.
    Nothing is shuffled: a batch of about ``batch_tokens`` ids is packed in the task that reads
    the texts, so a sequence is left open at most once per batch and room.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = picked.limit(0).toArrow().schema.field("doc_id").type

    def packed(pieces: list[tuple], dtype) -> pa.RecordBatch:
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        bins = best_fit(sizes, length)
        order = np.lexsort((np.arange(len(bins)), bins))
        n = int(bins.max()) + 1
        ids = np.full((n, length), pad_id, dtype)
        places = np.zeros((n, length), np.uint16 if length <= 65536 else np.uint32)
        rows = [([0], [], []) for _ in range(n)]
        for i in order.tolist():
            doc, start, part = pieces[i]
            cuts, owners, starts = rows[bins[i]]
            at = cuts[-1]
            ids[bins[i], at : at + len(part)] = part
            places[bins[i], at : at + len(part)] = np.arange(len(part))
            cuts.append(at + len(part))
            owners.append(doc)
            starts.append(start)
        name = attempt_name("packed")
        write_file(folder, f"{name}.ids.npy", as_npy(ids))
        write_file(folder, f"{name}.positions.npy", as_npy(places))
        write_file(folder, f"{name}.lengths.npy", as_npy(np.concatenate([np.array(r[0], np.int32) for r in rows])))
        crc = [zlib.crc32(ids[b, : rows[b][0][-1]].astype("<u4").tobytes()) for b in range(n)]
        return pa.RecordBatch.from_pydict(
            {
                "file": pa.array([name] * n),
                "row": pa.array(range(n), pa.int32()),
                "n_tokens": pa.array([r[0][-1] for r in rows], pa.int32()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "cu_seqlens": pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                "doc_ids": pa.array([r[1] for r in rows], pa.list_(id_type)),
                "starts": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        small = coder.tokenizer.get_vocab_size() <= 65536 and max(end_id, pad_id) < 65536
        dtype = np.uint16 if small else np.uint32
        pieces, held = [], 0
        for batch in batches:
            _, starts = text_bytes(batch.column(1))
            for low, high in slices(starts, SLICE_BYTES):
                names = batch.column(0)[low:high].to_pylist()
                texts = [t or "" for t in batch.column(1)[low:high].to_pylist()]
                for name, ids in zip(names, coder.batch(texts)):
                    ids = np.frombuffer(ids + end, "<u4").astype(dtype)
                    for at in range(0, len(ids), length):
                        pieces.append((name, at, ids[at : at + length]))
                        held += len(pieces[-1][2])
                        if held >= batch_tokens:
                            yield packed(pieces, dtype)
                            pieces, held = [], 0
        if pieces:
            yield packed(pieces, dtype)

    schema = (
        "file string, row int, n_tokens int, ids_crc32 bigint, cu_seqlens array<int>, "
        f"doc_ids array<{kind}>, starts array<bigint>"
    )
    return materialised(map_text(picked, run, schema))


def read_packed(folder: str, file: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, position ids and cumulative lengths per row of one packed file."""
    system, path = located(folder)
    ids, places, lengths = (
        np.load(io.BytesIO(system.open_input_stream(f"{path}/{file}.{part}.npy", compression=None).read()))
        for part in ("ids", "positions", "lengths")
    )
    return ids, places, np.split(lengths, np.flatnonzero(lengths == 0)[1:])
