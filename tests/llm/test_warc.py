import base64
import hashlib
import io
from pathlib import Path

import pytest
import zstandard

from phenoframe.llm import warc
from phenoframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(pages, min_bytes=0):
    best = {}
    for i, html in pages:
        body = (html or "").encode()
        if i is not None and len(body) >= min_bytes:
            best[body] = min(best.get(body, i), i)
    out = []
    for i, html in pages:
        body = (html or "").encode()
        first = best.get(body)
        revisit = first is not None and first != i
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    rows = QUERIES["op4_warc"](spark, SF).collect()
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, rows), key=str) == brute(pages)


ODD = [(5, "u", "same"), (3, "u", "same"), (3, None, "same"), (None, "x y\n", "same"), (7, "", None), (8, "", ""), (9, "é", "ünï" * 300_000), (10, "z", "a\r\n\r\nb")]


@pytest.mark.parametrize("min_bytes", [0, 1, 1000])
def test_round_trip(spark, tmp_path, monkeypatch, min_bytes):
    pages = spark.createDataFrame([(*r, 1) for r in ODD], "page_id bigint, url string, html string, size int")
    folder = f"file:{tmp_path}/w"
    manifest = warc.write_archives(pages, folder, min_bytes=min_bytes)
    records = warc.read_archives(manifest, folder)
    rows = manifest.join(records, ["archive", "frame", "offset"]).collect()
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"])) for r in rows]
    assert sorted(got, key=str) == brute([(r[0], r[2]) for r in ODD], min_bytes)
    stored = {(r["page_id"], bytes(r["payload"])) for r in rows if r["record_type"] == "response"}
    assert (9, ("ünï" * 300_000).encode()) in stored and (10, b"a\r\n\r\nb") in stored
    some = warc.read_records(manifest.where("page_id in (3, 10)"), folder).collect()
    assert sorted(r["record_id"] for r in some) == ["10", "3", "3"]
    assert warc.read_archives(warc.write_archives(pages.where("false"), folder), folder).collect() == []


def test_archive_is_plain_zstandard(spark, tmp_path):
    bundle = warc.Bundle()
    parts = [bytes([65 + i]) * 200_000 for i in range(5)]
    places = [bundle.add(p) for p in parts]
    path = Path(tmp_path, "a.zst")
    path.write_bytes(bundle.data())
    reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(path.read_bytes()), read_across_frames=True)
    assert reader.read() == b"".join(parts)
    system, name = warc.located(str(path))
    with system.open_input_file(name) as file:
        frames = warc.seek_table(file)
        assert len(frames) == 3
        for (n, at), p in zip(places, parts):
            assert warc.read_frame(file, frames[n])[at : at + len(p)] == p
    path.write_bytes(path.read_bytes()[:-1])
    with system.open_input_file(name) as file, pytest.raises(ValueError):
        warc.seek_table(file)


def test_any_text_names_a_record(spark, tmp_path):
    ids = ["a\r\nWARC-Type: x", "b\n\n", "<c>", "%41", "%", "", "None", None, "d e\x00", "é "]
    pages = spark.createDataFrame([(i, "u", f"body {n}") for n, i in enumerate(ids)] + [("z", "u", "body 0")], "page_id string, url string, html string")
    folder = f"file:{tmp_path}/w"
    manifest = warc.write_archives(pages, folder)
    rows = manifest.join(warc.read_archives(manifest, folder), ["archive", "frame", "offset"]).collect()
    assert len(rows) == len(ids) + 1 and all(r["page_id"] == r["record_id"] for r in rows)
    assert {r["record_id"]: r["refers_to"] for r in rows if r["record_type"] == "revisit"} == {"z": ids[0]}
