import base64
import gzip
import hashlib
import random

import pytest

from vacantia.llm import warc

SCHEMA = "page_id long, url string, html binary, digest int, row string"


def pages():
    rng = random.Random(5)
    rows = [(1, "http://a/1", b"<p>one</p>"), (2, "http://a/2", None), (3, None, b""), (4, "u\r\nX-Forged: 1", b"<p>one</p>"), (4, "u", b"<p>one</p>"), (None, "n", b"<p>one</p>"), (None, "n", b"only null")]
    rows += [(10 + k, f"http://b/{k}", bytes(rng.randrange(256) for _ in range(rng.choice((0, 1, 63, 64, 65, 700, 5000))))) for k in range(60)]
    rows += [(100, "d", b"x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"), (101, "http://x/WARC/1.0/e", warc.MARK), (102, "f", b"y" * 40 + (warc.END + warc.MARK) * 9), (103, "g", b"0\r\n\r\n"), (104, "h", warc.END * 5)]
    rows += [(200 + k, "hot", b"same") for k in range(40)] + [(5, "long", bytes(range(256)) * 900)]
    return [(*r, 7, "x") for r in rows]


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows, least=0):
    known, out = {}, []
    for page, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = html or b""
        again = len(body) >= least and body in known
        out.append((page, len(body), b32(body), "revisit" if again else "response", known[body] if again else None))
        if len(body) >= least:
            known.setdefault(body, page)
    return sorted(out, key=str)


@pytest.mark.parametrize(("segment", "chunk", "least"), [(1 << 14, 1 << 12, 0), (64, 50, 0), (300, 7, 5), (100, 1000, 10**9)])
def test_round_trip(spark, tmp_path, segment, chunk, least):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(5)
    path = str(tmp_path / "archives")
    warc.write_archives(df, path, segment=segment, chunk=chunk, least=least)
    read = warc.reassemble(warc.read_records(spark, path))
    got = warc.resolved(read).collect()
    assert all(r.complete for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(pages(), least)
    bodies = {r.page_id: bytes(r.payload) for r in read.filter("type = 'response' and page_id >= 10").collect()}
    assert all(bodies[r[0]] == r[2] for r in pages() if r[0] in bodies)
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "archives").glob("*.gz"))
    assert b"\r\nX-Forged" not in raw


def archive(spark, tmp_path, name, *files):
    path = tmp_path / name
    path.mkdir()
    for k, f in enumerate(files):
        (path / f"{k}.warc.gz").write_bytes(gzip.compress(f))
    return warc.read_records(spark, str(path))


def record(kind, rid, block, *lines, length=None):
    head = "".join(f"{x}\r\n" for x in ("WARC/1.0", f"WARC-Type: {kind}", f"warc-record-id: <urn:uuid:{rid}>", *lines, f"Content-Length: {len(block) if length is None else length}"))
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def test_segments_over_archives_in_any_order_and_repeated(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\ntransfer-encoding:\r\n chunked\r\n\r\n" + b"5;name=v\r\nhello\r\n6\r\n world\r\n0\r\nTrailer: x\r\n\r\n"
    n = len(http)
    a = record("response", "r", http[:20], "WARC-Segment-Number: 1", f"WARC-Payload-Digest: sha1:{b32(b'hello world')}", "X-Page-Id: 9")
    b = record("continuation", "c2", http[20:60], "WARC-Segment-Origin-ID: <urn:uuid:r>", "WARC-Segment-Number: 2")
    c = record("continuation", "c3", http[60:], "WARC-Segment-Origin-ID: <urn:uuid:r>", "WARC-Segment-Number: 3", f"WARC-Segment-Total-Length: {n}")
    info = record("warcinfo", "i", b"software: x\r\n")
    (r,) = warc.reassemble(archive(spark, tmp_path, "whole", info + c, b, b + a)).filter("type = 'response'").collect()
    assert (bytes(r.payload), r.complete, r.page_id, r.payload_digest) == (b"hello world", True, 9, b32(b"hello world"))
    for name, files in {"missing": (a + c,), "no total": (a + b,), "no first": (b + c,), "wrong": (a + b, c.replace(f"Length: {n}".encode(), f"Length: {n + 1}".encode()))}.items():
        (r,) = warc.reassemble(archive(spark, tmp_path, name, *files)).collect()
        assert not r.complete and (r.type is None) == (name == "no first")


def test_broken_archives(spark, tmp_path):
    whole = record("response", "w", b"HTTP/1.1 200 OK\r\n\r\nplain")
    short = record("response", "s", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhel")
    cut = record("response", "x", b"abc", length=500)
    lying = record("response", "l", b"HTTP/1.1 200 OK\r\n\r\nplain", f"WARC-Payload-Digest: sha1:{b32(b'other')}")
    lost = record("revisit", "v", b"", "WARC-Refers-To: <urn:uuid:nowhere>", "WARC-Payload-Digest: sha1:ABC")
    read = warc.reassemble(archive(spark, tmp_path, "broken", whole + short + lying + lost + cut, b"no archive\r\n\r\nat all"))
    assert {r.record_id: r.complete for r in read.collect()} == {"w": True, "s": False, "l": False, "x": False, "v": True}
    (r,) = warc.resolved(read).filter("record_type = 'revisit'").collect()
    assert (r.payload_bytes, r.payload_digest, r.refers_to, r.complete) == (None, "ABC", None, False)


def test_records_that_end_at_any_place_of_the_readers_buffer(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, f"http://c/{k}", rng.choice((b"\r\n", b"W", b"WARC/1", b"ab")) * rng.randrange(400)) for k in range(3000)]
    path = str(tmp_path / "many")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html binary").coalesce(1), path, least=10**9)
    for cut in (b"", b"z"):  # the same records, shifted
        files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "many").glob("*.gz")]
        read = warc.reassemble(archive(spark, tmp_path, f"shifted{len(cut)}", *[cut * 7 + f for f in files]))
        assert {r.page_id: bytes(r.payload) for r in read.filter("complete").collect()} == {r[0]: r[2] for r in rows}


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.resolved(warc.reassemble(warc.read_records(spark, path))).collect() == []
