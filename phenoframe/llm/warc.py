"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. A footer, itself a skippable
frame, lists the compressed and plain size of every frame, so a reader finds the frame of any
offset from the file's end. A manifest maps record ids to archive, frame and the offset inside
the plain frame; ordinary Zstandard readers can still read an archive from start to end.

Payloads that equal an earlier one are stored as ``revisit`` records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from phenoframe.llm.files import attempt_name, located, write_file
from phenoframe.llm.text import map_text
from phenoframe.scale.bounds import materialised

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 256 << 10  # plain bytes after which a frame ends
ARCHIVE_BYTES = 64 << 20  # compressed bytes after which an archive ends
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Bundle:
    """Frames of one archive and its seek table."""

    def __init__(self, level: int = 3):
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_size = self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number and offset of the record in the plain frame."""
        place = len(self.sizes), self.open_size
        self.open.append(record)
        self.open_size += len(record)
        if self.open_size >= FRAME_BYTES:
            self.end_frame()
        return place

    def end_frame(self) -> None:
        if self.open:
            packed = self.compressor.compress(b"".join(self.open))
            self.parts.append(packed)
            self.sizes.append((len(packed), self.open_size))
            self.size += len(packed)
            self.open, self.open_size = [], 0

    def data(self) -> bytes:
        self.end_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        head = struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer))
        return b"".join([*self.parts, head, entries, footer])


def seek_table(file) -> list[tuple[int, int, int]]:
    """``(offset, compressed size, plain size)`` of every frame, read from the file's end."""
    size = file.size()
    n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    entry = 12 if flags & 0x80 else 8
    if magic != SEEKABLE_MAGIC or size < 17 + n * entry:
        raise ValueError("not a seekable archive")
    raw = file.read_at(n * entry, size - 9 - n * entry)
    frames, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", raw, i * entry)
        frames.append((at, packed, plain))
        at += packed
    return frames


def read_frame(file, frame: tuple[int, int, int]) -> bytes:
    at, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(file.read_at(packed, at), max_output_size=plain)


NO_NAME = "%"  # names a record without id; no other name is a bare percent sign


def record_name(page: object) -> str:
    """An id as part of a header line: blanks, controls, ``<``, ``>`` and ``%`` are escaped."""
    return NO_NAME if page is None else re.sub(r"[\x00-\x20%<>\x7f]", lambda m: f"%{ord(m[0]):02X}", str(page))


def named_id(name: str) -> str | None:
    """The id that a name was made of."""
    return None if name == NO_NAME else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), name)


def record_bytes(kind: str, name: str, url: str, digest: str, size: int, payload: bytes, refers: str | None) -> bytes:
    """A WARC/1.1 record with an HTTP message as its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:record:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:record:{refers}>"]
    block = http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no record here")
    fields = dict(line.split(": ", 1) for line in lines)
    low = end + 4
    high = low + int(fields["Content-Length"])
    return fields, data[low:high], high + 4


def payload_of(block: bytes) -> bytes:
    return block[block.index(b"\r\n\r\n") + 4 :]


def with_originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Each row with the smallest id among equal payloads, null where it stands for itself.

    Payloads are equal when length and SHA-256 are. Only ids and digests meet, groups combine
    before their shuffle, and the join is with a written table of groups that have copies.
    """
    groups = (
        pages.where(F.col("size") >= min_bytes)
        .groupBy("sha", "size")
        .agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    copies = materialised(
        groups.select(F.col("sha").alias("_sha"), F.col("size").alias("_size"), "original")
    )
    same = (pages["sha"] == copies["_sha"]) & (pages["size"] == copies["_size"])
    refers = F.when(F.coalesce(F.col("page_id") > F.col("original"), F.col("original").isNotNull() & F.col("page_id").isNull()), F.col("original"))
    return pages.join(copies, same, "left").select(*pages.columns, refers.alias("refers_to"))


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
) -> DataFrame:
    """Write one record per row into archives in ``folder``; return the manifest.

    ``(page_id, archive, frame, offset, length)``: the record starts ``offset`` bytes into the
    plain frame. The payload is the text in UTF-8; null texts are empty payloads, null URLs
    ``about:blank``. Of equal payloads of at least ``min_bytes`` the row with the smallest id
    is the response and all others are revisits; rows that share the smallest id are all
    responses, and a row without id revisits any row with one. Record names are made of the
    ids, so rows with equal ids have equal names. Tasks write archives of their own; only
    archives in the manifest count.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("about:blank")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.select("*", F.sha2("payload", 256).alias("sha"), F.octet_length("payload").alias("size"))
    marked = with_originals(rows, min_bytes).select("page_id", "url", "payload", F.col("refers_to").cast("string").alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, places, ids = Bundle(), [], []

        def finish():
            name = attempt_name("pages") + ".warc.zst"
            write_file(folder, name, bundle.data())
            frame, offset, length = zip(*places)
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(ids),
                    pa.array([name] * len(places)),
                    pa.array(frame, pa.int32()),
                    pa.array(offset, pa.int64()),
                    pa.array(length, pa.int64()),
                ],
                ["page_id", "archive", "frame", "offset", "length"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, refers = (batch.column(c)[i].as_py() for c in range(4))
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                record = record_bytes(
                    "response" if refers is None else "revisit",
                    record_name(page), url, digest, len(payload), payload if refers is None else b"",
                    None if refers is None else record_name(refers),
                )
                places.append((*bundle.add(record), len(record)))
                ids.append(batch.column(0).slice(i, 1))
                if bundle.size >= ARCHIVE_BYTES:
                    yield finish()
                    bundle, places, ids = Bundle(), [], []
        if places:
            yield finish()

    schema = f"page_id {kind}, archive string, frame int, offset bigint, length bigint"
    return materialised(map_text(marked, run, schema))


RECORD = (
    "archive string, frame int, offset bigint, record_id string, record_type string, "
    "payload_bytes bigint, payload_digest string, refers_to string, payload binary"
)


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def record_row(archive: str, frame: int, at: int, fields: dict, block: bytes) -> tuple:
    name = lambda key: named_id(fields[key][len("<urn:record:") : -1]) if key in fields else None
    return (
        archive, frame, at, name("WARC-Record-ID"), fields["WARC-Type"], int(fields["WARC-Payload-Length"]),
        fields["WARC-Payload-Digest"].removeprefix("sha1:"), name("WARC-Refers-To"), payload_of(block),
    )


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives named in column ``archive``, frame by frame.

    A stored payload must have the length and digest in its header, else reading fails.
    ``refers_to`` is the name of the record that a revisit stands for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = located(folder)
                with system.open_input_file(f"{path}/{archive}") as file:
                    for n, frame in enumerate(seek_table(file)):
                        plain, at, rows = read_frame(file, frame), 0, []
                        while at < len(plain):
                            fields, block, end = parse_record(plain, at)
                            row = record_row(archive, n, at, fields, block)
                            if row[4] == "response":
                                digest = base64.b32encode(hashlib.sha1(row[8]).digest()).decode()
                                if (len(row[8]), digest) != row[5:7]:
                                    raise ValueError(f"{archive}: payload of {row[3]} is damaged")
                            rows.append(row if with_payload else (*row[:8], None))
                            at = end
                        yield record_batch(rows)

    named = materialised(archives.select("archive").distinct())
    # a task per archive; their names are too few bytes to keep them apart by size
    return named.repartition(max(1, named.count())).mapInArrow(run, RECORD)


def read_records(wanted: DataFrame, folder: str) -> DataFrame:
    """The records at the places of manifest rows; only their frames are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, last, plain = [], None, b""
            for archive, frame, at in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if (archive, frame) != last:
                    system, path = located(folder)
                    with system.open_input_file(f"{path}/{archive}") as file:
                        plain, last = read_frame(file, seek_table(file)[frame]), (archive, frame)
                fields, block, _ = parse_record(plain, at)
                rows.append(record_row(archive, frame, at, fields, block))
            yield record_batch(rows)

    places = wanted.select("archive", "frame", "offset")
    near = places.repartition("archive", "frame").sortWithinPartitions("archive", "frame", "offset")
    return near.mapInArrow(run, RECORD)
