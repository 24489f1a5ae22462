"""WARC archives: writing pages as segmented records, and reassembling records from archives read back.

``write_archives`` writes one record a page (payloads that equal an earlier page's as revisits), each HTTP body in
chunked transfer framing, blocks of more than ``segment`` bytes as a first segment and continuation records.  The
archives are gzip files of the shared folder, written and read by Spark's text source with separators of the format,
so that neither side needs a file system of its own.

``read_records`` streams an archive: pieces begin with ``WARC/1.``, a record takes pieces until it has its headers and as many
bytes as its Content-Length (the mark may stand in a URL or a block), and what follows it is the next record.  One record is in memory at a time.
``reassemble`` groups a record's segments by the identifier of their origin, in whatever archive they are, orders them by number,
verifies that the numbers are 1 to n and add up to the stated total length, and takes the chunked framing off.
Records without segments are not shuffled, and a group never holds more than one record's block.

Defined cases: a null payload is empty; a null URL has no target header; line breaks in a URL become spaces; a null id has no id
header and is read back as null, and sorts last among equal payloads; rows that share id and payload are records of their
own, one of them the response; repeated segments count once; a record whose segments are missing, differ, or do not add
up, whose framing is broken, or whose file ends early is ``complete = false`` with what it has; continuations without an
origin's first segment give such a record without type; no pages give no archive and no records.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators.storage import checkpoint, drop

#: What ends headers and records, and what every record begins with.  Archives are cut before each of the latter: it does
#: not overlap itself, which Spark's reader needs to find it across its buffers.
END = b"\r\n\r\n"
MARK = b"WARC/1."
#: Bytes of a segment's block, of a chunk in transfer framing, and of rows given on at once.
SEGMENT, CHUNK, BATCH = 1 << 14, 1 << 12, 1 << 23
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = "x-page-id"

RECORD = "type string, record_id string, page_id bigint, uri string, refers_to string, digest string, origin string, segment int, total bigint, block binary, whole boolean, archive string"
READ = "record_id string, type string, page_id bigint, uri string, refers_to string, payload_bytes bigint, payload_digest string, stated_digest string, complete boolean, payload binary"


def _line(name: str, value) -> bytes:
    return f"{name}: {value}\r\n".encode() if value is not None else b""


def framed(payload: bytes, chunk: int) -> bytes:
    """``payload`` in chunked transfer framing."""
    out = [b"%x\r\n%b\r\n" % (len(piece), piece) for piece in (payload[k : k + chunk] for k in range(0, len(payload), chunk))]
    return b"".join([*out, b"0\r\n\r\n"])


def unframed(body: bytes) -> tuple[bytes, bool]:
    """The payload within chunked framing, and whether the framing is whole; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        size = body[at:stop].split(b";", 1)[0].strip() if stop >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return b"".join(out), False
        n, at = int(size, 16), stop + 2
        if n == 0:
            return b"".join(out), body.startswith(b"\r\n", at) or body.find(END, at) >= 0
        out.append(body[at : at + n])
        if body[at + n : at + n + 2] != b"\r\n":
            return b"".join(out), False
        at += n + 2


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _records(segment: int, chunk: int, date: str):
    def record(kind: str, rid: str, lines: list[bytes], block: bytes) -> bytes:
        head = [b"WARC/1.1\r\n", _line("WARC-Type", kind), _line("WARC-Record-ID", f"<urn:uuid:{rid}>"), _line("WARC-Date", date), *lines, _line("Content-Length", len(block))]
        return b"".join([*head, b"\r\n", block])

    def of(row: dict) -> Iterator[bytes]:
        lines = [_line("WARC-Target-URI", row["uri"]), _line(ID_HEADER, row["id"]), _line("WARC-Payload-Digest", "sha1:" + base32(bytes.fromhex(row["digest"]))), b"Content-Type: application/http; msgtype=response\r\n"]
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        if row["refers"] is not None:
            refers = [_line("WARC-Refers-To", f"<urn:uuid:{row['refers']}>"), _line("WARC-Profile", PROFILE)]
            yield record("revisit", row["rid"], [*lines, *refers], http + _line("Content-Length", row["size"]) + b"\r\n")
            return
        block = http + b"Transfer-Encoding: chunked\r\n\r\n" + framed(row["payload"], chunk)
        if len(block) <= segment:
            yield record("response", row["rid"], lines, block)
            return
        yield record("response", row["rid"], [*lines, b"WARC-Segment-Number: 1\r\n"], block[:segment])
        for number, at in enumerate(range(segment, len(block), segment), 2):
            last = _line("WARC-Segment-Total-Length", len(block)) if at + segment >= len(block) else b""
            own = hashlib.md5(f"{row['rid']}:{number}".encode()).hexdigest()
            rid = "-".join((own[:8], own[8:12], own[12:16], own[16:20], own[20:]))
            yield record("continuation", rid, [_line("WARC-Segment-Origin-ID", f"<urn:uuid:{row['rid']}>"), _line("WARC-Segment-Number", number), last], block[at : at + segment])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for k in range(batch.num_rows):
                for r in of({c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}):
                    out.append(r)
                    size += len(r)
                if size >= BATCH:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    return write


def _uuid(*parts: Column) -> Column:
    name = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, segment: int = SEGMENT, chunk: int = CHUNK, date: str = DATE) -> None:
    """Write ``pages`` as archives below ``path``, a file for each task.

    Of pages with equal payloads of at least ``least`` bytes, that with the smallest id is the response and the others revisit it.
    Only digests and ids are grouped; payloads move only if the table of repeated digests is too large for a broadcast.  Where rows share
    id and payload they are numbered in a written copy, so that exactly one of them is the response however tasks are repeated.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.translate(F.col(url_col), "\r\n", "  ").alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    keys = checkpoint(rows.groupBy("digest", "id").agg(F.count("*").alias("n"), F.max(F.length("payload")).alias("size")), "warc-keys")
    written = [keys]
    if keys.filter("n > 1").isEmpty():
        rows, keys = rows.withColumn("row", F.lit(0)), keys.withColumn("row", F.lit(0))
    else:
        rows = keys = checkpoint(rows.select("*", F.length("payload").alias("size"), F.monotonically_increasing_id().alias("row")), "warc-pages")
        written.append(rows)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    groups = keys.filter(F.col("size") >= least).groupBy(F.col("digest").alias("same")).agg(F.min(order).alias("first"), F.count("*").alias("members"))
    first = checkpoint(groups.filter("members > 1").select("same", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row")), "warc-first")
    written.append(first)
    rows = rows.join(first, F.col("digest") == F.col("same"), "left")
    again = F.col("same").isNotNull() & ~(F.col("first_id").eqNullSafe(F.col("id")) & (F.col("first_row") == F.col("row")))
    made = rows.select(
        "id", "uri", "digest", F.length("payload").alias("size"), _uuid(F.col("row"), F.col("id"), F.col("digest")).alias("rid"),
        F.when(again, _uuid(F.col("first_row"), F.col("first_id"), F.col("digest"))).alias("refers"), F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )
    out = made.mapInArrow(_records(segment, chunk, date), "value binary").select(F.col("value").cast("string"))
    out.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)
    for table in written:
        drop(table)


def _headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name, the first line (the version) left out; a line that begins with white space goes on."""
    fields: dict[str, str] = {}
    name = ""
    for line in head.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            fields[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.lstrip("-").isdigit() else None


def _bare(text: str | None) -> str | None:
    return None if text is None else text.strip("<>").removeprefix("urn:uuid:")


def _record(data: bytes, need: int | None, archive: str) -> dict:
    """The record in ``data`` (what follows the mark); ``need`` is its length, unknown where headers do not end or give no length."""
    stop = data.find(END)
    fields = _headers(data[: max(stop, 0)])
    digest = fields.get("warc-payload-digest")
    return {
        "type": fields.get("warc-type"), "record_id": _bare(fields.get("warc-record-id")), "page_id": _number(fields.get(ID_HEADER)), "uri": fields.get("warc-target-uri"), "refers_to": _bare(fields.get("warc-refers-to")),
        "digest": digest.rpartition(":")[2] if digest else None, "origin": _bare(fields.get("warc-segment-origin-id")), "segment": _number(fields.get("warc-segment-number")), "total": _number(fields.get("warc-segment-total-length")),
        "block": data[stop + 4 : need] if stop >= 0 else b"", "whole": need is not None and len(data) >= need, "archive": archive,
    }


_ARROW = pa.schema([
    ("type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("origin", pa.string()),
    ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("whole", pa.bool_()), ("archive", pa.string()),
])


class _Stream:
    """The records of one archive, fed with its bytes mark by mark."""

    def __init__(self, archive: str):
        self.archive, self.parts, self.have, self.need = archive, [], 0, None

    def feed(self, piece: bytes) -> Iterator[dict]:
        """Take the bytes after a mark; give the records that are whole now."""
        if self.parts:
            piece = MARK + piece
        while True:
            self.parts.append(piece)
            self.have += len(piece)
            if self.need is None:
                self.parts = [b"".join(self.parts)]
                stop = self.parts[0].find(END)
                if stop < 0:
                    return
                self.need = stop + 4 + max(0, _number(_headers(self.parts[0][:stop]).get("content-length")) or 0)
            if self.have < self.need:
                return
            data = b"".join(self.parts)
            yield _record(data, self.need, self.archive)
            piece = data[self.need :].lstrip(b"\r\n")
            self.parts, self.have, self.need = [], 0, None
            if not piece.startswith(MARK):
                return
            piece = piece[len(MARK) :]

    def close(self) -> Iterator[dict]:
        """The record that the archive's end cut off."""
        if self.parts:
            yield _record(b"".join(self.parts), self.need, self.archive)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of archives whose pieces come in order, file after file; what stands before a file's first mark is no record."""

    def records() -> Iterator[dict]:
        stream = None
        for batch in batches:
            for value, archive in zip(batch.column(0), batch.column(1), strict=True):
                if stream is None or stream.archive != archive.as_py():
                    if stream:
                        yield from stream.close()
                    stream = _Stream(archive.as_py())
                else:
                    yield from stream.feed(value.as_py())
        if stream:
            yield from stream.close()

    out, size = [], 0
    for r in records():
        out.append(r)
        size += len(r["block"])
        if size >= BATCH:
            yield pa.RecordBatch.from_pylist(out, _ARROW)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, _ARROW)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the gzip archives below ``path`` as ``RECORD``, segments as they stand."""
    pieces = spark.read.option("lineSep", MARK.decode()).text(path)
    return pieces.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("archive")).mapInArrow(_read, RECORD)


_OUT = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("stated_digest", pa.string()), ("complete", pa.bool_()), ("payload", pa.binary()),
])


def _decoder(payload: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                block, complete = b"".join(row.pop("blocks")), row.pop("ordered")
                if block.startswith(b"HTTP/"):
                    head, _, body = block.partition(END)
                    if "chunked" in _headers(head).get("transfer-encoding", "").lower():
                        body, framing = unframed(body)
                        complete = complete and framing
                else:
                    body = block
                if row["type"] == "revisit":
                    row |= {"payload_bytes": None, "payload_digest": row["stated_digest"], "payload": None}
                else:
                    own = base32(hashlib.sha1(body).digest())
                    complete = complete and row["stated_digest"] in (None, own)
                    row |= {"payload_bytes": len(body), "payload_digest": own, "payload": body if payload else None}
                out.append(row | {"complete": complete})
                size += len(body) if payload else 0
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist(out, _OUT)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, _OUT)

    return decode


def reassemble(records: DataFrame, *, payload: bool = True) -> DataFrame:
    """``READ``: a row for each record that is not a continuation, its payload decoded (left out unless ``payload``)."""
    columns = ["record_id", "type", "page_id", "uri", "refers_to", F.col("digest").alias("stated_digest")]
    alone = F.col("segment").isNull() & ~F.coalesce(F.col("type") == "continuation", F.lit(False))
    whole = records.filter(alone).select(*columns, F.array("block").alias("blocks"), F.col("whole").alias("ordered"))
    parts = records.filter(~alone).withColumn("origin", F.when(F.col("type") == "continuation", F.col("origin")).otherwise(F.col("record_id")))
    first = F.col("type") != "continuation"
    taken = lambda c: F.max(F.when(first, F.col(c)))
    groups = parts.groupBy("origin").agg(
        *[taken(c).alias(c) for c in ("type", "page_id", "uri", "refers_to", "digest")], F.max("total").alias("total"), F.min("whole").alias("whole"), F.collect_set(F.struct("segment", "block")).alias("segments")
    )
    groups = groups.withColumn("segments", F.array_sort("segments"))
    numbers, lengths = F.transform("segments", lambda x: x["segment"]), F.transform("segments", lambda x: F.length(x["block"]).cast("bigint"))
    counted = (numbers == F.sequence(F.lit(1), F.size("segments"))) & (F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x) == F.col("total"))
    joined = groups.select(
        F.col("origin").alias("record_id"), *columns[1:], F.transform("segments", lambda x: x["block"]).alias("blocks"), (F.col("whole") & F.coalesce(counted, F.lit(False)) & F.col("type").isNotNull()).alias("ordered")
    )
    return whole.union(joined).mapInArrow(_decoder(payload), READ)


def resolved(read: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, complete): revisits with the response's id and length.

    A revisit whose response is not in the archives keeps its stated digest and is not complete.
    """
    own = read.filter("type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"), "complete")
    there = read.filter("type = 'response'").select(F.col("record_id").alias("there"), F.col("page_id").alias("response"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"), F.col("complete").alias("ok"))
    later = read.filter("type = 'revisit'").join(there, F.col("refers_to") == F.col("there"), "left")
    again = later.select(
        "page_id", F.col("n").alias("payload_bytes"), F.coalesce("d", "payload_digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("response").alias("refers_to"), (F.col("complete") & F.coalesce("ok", F.lit(False))).alias("complete")
    )
    return own.union(again)
