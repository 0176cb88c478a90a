"""WARC archives: what is written comes back, whatever the texts hold and however the files are cut."""

import base64
import gzip
import hashlib

import pytest

from gridloom.llm import warc

PAGES = "page_id long, url string, html string, kind string, row string, payload string, digest string, n_bytes long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z", "d", 1) for i, u, h in rows], PAGES)


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows):
    rows = [(i if i is not None else -1, k, (h or "").encode()) for k, (i, _, h) in enumerate(rows)]
    last = {}
    for i, k, h in rows:
        last[h] = max(last.get(h, (-2, -2)), (i, k))
    none = lambda i: None if i == -1 else i
    return sorted(((none(i), len(h), sha(h), "response" if last[h] == (i, k) else "revisit", None if last[h] == (i, k) else none(last[h][0])) for i, k, h in rows), key=repr)


def back(spark, path, keep=False):
    whole = warc.reassembled(warc.records(spark, path, keep), keep)
    assert [r for r in whole.filter("problem IS NOT NULL").collect()] == []
    out = warc.resolved(whole)
    return whole, sorted(map(tuple, out.select("page_id", "n_bytes", "digest", "kind", "refers_to").collect()), key=repr)


ODD = [
    (1, "http://a", "plain"),
    (2, "http://a\r\nWARC-Type: x", None),
    (3, None, ""),
    (4, "http://b", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 300),
    (5, "WARC/1.1", "WARC/1." * 2000),
    (6, "http://c", "ß中\U0001f600" * 9000),
    (7, "http://c", "plain"),
    (7, "http://c", "plain"),
    (7, "http://d", "plain"),
    (8, "u", "\r\n"),
    (9, "u", "0\r\n\r\n"),
    (None, "u", "of no page"),
    (None, "u", "of no page"),
]


@pytest.mark.parametrize(("segment", "chunk"), [(8192, 4096), (100, 7), (1 << 20, 1 << 20)])
def test_round_trip(spark, tmp_path, segment, chunk):
    path = f"file://{tmp_path}/a"
    warc.written(pages(spark, ODD).repartition(3), path, segment, chunk, per_file=50)
    whole, got = back(spark, path, keep=True)
    assert got == brute(ODD)
    texts = {r["block"].decode() for r in whole.filter("kind = 'response'").collect()}
    assert texts == {h or "" for _, _, h in ODD}


def test_hot_payload_is_one_response(spark, tmp_path):
    rows = [(i, "u", "same") for i in range(3000)] + [(5000 + i, "u", f"own {i}") for i in range(50)]
    warc.written(pages(spark, rows), f"file://{tmp_path}/a")
    assert back(spark, f"file://{tmp_path}/a")[1] == brute(rows)


def test_very_long_text(spark, tmp_path):
    rows = [(1, "u", "long " * 1_000_000), (2, "u", "short")]
    warc.written(pages(spark, rows), f"file://{tmp_path}/a")
    assert back(spark, f"file://{tmp_path}/a")[1] == brute(rows)


def test_empty(spark, tmp_path):
    warc.written(pages(spark, []), f"file://{tmp_path}/a")
    assert back(spark, f"file://{tmp_path}/a")[1] == []


def record(fields, block, version=b"1.0"):
    return b"WARC/" + version + b"\r\n" + b"".join(b"%b: %b\r\n" % f for f in fields) + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def response(name, block, *more):
    return record([(b"WARC-Type", b"response"), (b"WARC-Record-ID", name), *more], block)


HTTP = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"


def test_plain_files_in_several_splits(spark, tmp_path):
    """A plain file is read by many tasks, also where blocks with the mark itself lie across their borders."""
    bodies = [b"x%d " % i * 40 + (b"WARC/1.1\r\nnot a record" * 30 if i % 5 == 0 else b"") for i in range(200)]
    (tmp_path / "f.warc").write_bytes(record([(b"WARC-Type", b"warcinfo")], b"software: x") + b"".join(response(b"<r%d>" % i, HTTP + b) for i, b in enumerate(bodies)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = warc.records(spark, f"file://{tmp_path}/f.warc")
        got = sorted((r["record_id"], r["n_bytes"], r["made_digest"]) for r in found.filter("kind = 'response'").collect())
        assert found.filter("problem IS NOT NULL OR cut").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == sorted((f"<r{i}>", len(b), sha(b)) for i, b in enumerate(bodies))


def part(origin, number, block, *more):
    return record([(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", b"<%b-%d>" % (origin[1:-1], number)), (b"WARC-Segment-Origin-ID", origin), (b"WARC-Segment-Number", b"%d" % number), *more], block)


def test_segments_out_of_order_and_problems(spark, tmp_path):
    """Segments of other writers: in any order and file, repeated, missing, of a wrong total, with broken framing."""
    total = lambda n: (b"WARC-Segment-Total-Length", b"%d" % n)
    first = (b"WARC-Segment-Number", b"1")
    chunks = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, chunked\r\n\r\n4;x=y\r\nabcd\r\n3\r\nefg\r\n0\r\nTrailer: t\r\n\r\n"
    files = {
        "a.warc": part(b"<good>", 3, chunks[90:], total(len(chunks))) + response(b"<good>", chunks[:61], first) + response(b"<gap>", b"HTTP/1.1 200 OK\r\n\r\nab", first) + part(b"<gap>", 3, b"c", total(23)),
        "b.warc": part(b"<good>", 2, chunks[61:90]) + part(b"<good>", 2, chunks[61:90]) + response(b"<short>", HTTP + b"ab", first) + part(b"<short>", 2, b"c", total(99)) + part(b"<headless>", 2, b"c", total(1)),
        "c.warc": response(b"<open>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\nab") + response(b"<broken>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\nab") + response(b"<false>", HTTP + b"ab", (b"WARC-Payload-Digest", b"sha1:AAAA")),
        "d.warc": response(b"<last>", HTTP + b"ab") + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 500\r\n\r\ncut off",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    with gzip.open(tmp_path / "e.warc.gz", "wb") as f:
        f.write(response(b"<zipped>", HTTP + b"zip"))
    rows = {r["record_id"]: r for r in warc.reassembled(warc.records(spark, f"file://{tmp_path}", True), True).collect()}
    assert rows["<good>"]["block"] == b"abcdefg" and rows["<good>"]["problem"] is None
    assert rows["<zipped>"]["block"] == b"zip" and rows["<last>"]["block"] == b"ab"
    wrong = {k: r["problem"] for k, r in rows.items() if r["problem"]}
    assert wrong == {
        "<gap>": "segments are missing",
        "<short>": "the segments have another length than is said",
        "<headless>": "segments are missing",
        "<open>": "the framing has no end",
        "<broken>": "the framing is broken",
        "<false>": "the payload has another digest",
        None: "the file ends within a record",
    }


@pytest.mark.parametrize("step", [1, 2, 5, 1000])
def test_body_in_any_pieces(step):
    data = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n" + warc.chunked(b"0\r\n\r\n, some text, \r\n" * 9, 5)
    body = warc.Body(True)
    for i in range(0, len(data), step):
        body.feed(data[i : i + step])
    assert body.payload() == b"0\r\n\r\n, some text, \r\n" * 9 and body.problem is None
