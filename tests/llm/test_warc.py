import base64
import gzip
import hashlib

import pyarrow as pa
from structdoc.llm import warc as W

PAGES = "page_id long, url string, html string, payload string, rows long"


def pages():
    html = ["<p>one</p>", "", None, "<p>two é</p>" * 2000, "<p>one</p>", "<p>one</p>", "WARC/1.1\r\n\r\n", "x" * 3_000_000]
    return [(i, None if i == 3 else f"http://a.example/ {i}\n", h, "p", 1) for i, h in enumerate(html)] + [(4, "u", "<p>one</p>", "p", 1), (None, "u", "<p>one</p>", "p", 1), (None, None, "alone", None, None)]


def expected(data, least=0):
    out = []
    for p, _, h, *_ in data:
        body = (h or "").encode()
        ids = [q for q, _, g, *_ in data if (g or "") == (h or "") and q is not None]
        first = min(ids, default=None)
        revisit = len(body) >= least and first is not None and p != first
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_archives_come_back(spark):
    frame = spark.createDataFrame(pages(), PAGES)
    assert sorted(map(tuple, W.archive_pages(frame).collect()), key=repr) == expected(pages())
    assert sorted(map(tuple, W.archive_pages(frame, min_revisit_bytes=11).collect()), key=repr) == expected(pages(), 11)
    assert W.archive_pages(spark.createDataFrame([], PAGES)).collect() == []


def test_any_split_gives_every_record_once(spark, tmp_path):
    path = str(tmp_path / "archive")
    W.write_warc(spark.createDataFrame(pages(), PAGES).coalesce(1), path)
    whole = sorted((r.record_id, r.payload_bytes, bytes(r.payload)) for r in W.read_warc(spark, path).collect())
    assert len(whole) == len(pages())
    for size in (97, 1000, 5000):
        assert sorted((r.record_id, r.payload_bytes, bytes(r.payload)) for r in W.read_warc(spark, path, split_bytes=size).collect()) == whole


def test_archives_are_gzip_members_of_warc_records(spark, tmp_path):
    path = tmp_path / "archive"
    W.write_warc(spark.createDataFrame(pages(), PAGES), str(path))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in sorted(path.glob("*.warc.gz")))
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(pages())
    assert not [f for f in path.iterdir() if f.name.startswith("_")]


def test_false_magic_and_damage_are_passed_over():
    record = lambda i: W.encode_record(f"urn:page:{i}", "u", b"payload %d" % i, "D", None, "d")
    data = b"\x1f\x8b\x08junk" + gzip.compress(b"no record") + record(1) + b"padding" + record(2)[:-20] + record(3)
    rows = [r for m in W.members(pa.BufferReader(data), 0, len(data)) for r in W.parse_records(m)]
    assert [r[0] for r in rows] == ["urn:page:1", None, "urn:page:3"] and [r[1] for r in rows] == ["response", "damaged", "response"]


def test_malformed_headers_are_rows(spark, tmp_path):
    import pytest

    good = W.encode_record("urn:page:1", "u", b"payload", "D", None, "d")
    bad = gzip.compress(b"WARC/1.1\r\nContent-Length: many\r\n\r\nx") + gzip.compress(b"WARC/1.1\r\nno end of the header") + gzip.compress("WARC/1.1\r\nContent-Length: ２\r\n\r\n".encode())
    (tmp_path / "a.warc.gz").write_bytes(good + bad + good)
    assert sorted(r.record_type for r in W.read_warc(spark, str(tmp_path)).collect()) == ["damaged"] * 3 + ["response"] * 2
    (tmp_path / "b.warc").write_bytes(b"")
    with pytest.raises(Exception, match="gzip member"):
        W.read_warc(spark, str(tmp_path)).collect()
