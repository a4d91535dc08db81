"""WARC archives: a writer with revisit records, and a salvage reader.

Writing: one record per page, as an HTTP response. Of the pages with equal payloads of at least ``least`` bytes,
the one with the smallest id is a response and the others are revisits without payload. Archives go through
Spark's own text writer (a record's last line feed is the writer's separator), so they are committed like
any table and live in whatever store the shared folder is in. Tasks put records together to chunks of
``CHUNK_BYTES`` and archives of ``ARCHIVE_BYTES``; larger records are written apart, so they don't thin out the rest.

Reading: archives of plain records, of gzip members with one record or several, or of both. A record must have a
version line, its fields, all of its block, the closing blank lines, and the digests that it states. Where a check
fails, the reader searches for whichever comes next, gzip member or version line, that passes all of them, goes on
from there, and logs the bytes in between as a quarantined gap. What a broken member gives before it breaks is
searched for records as well. An archive is read whole by one task, in several copies: two
of 127 MB at once are too much for an executor with 1.8 GB of heap.

The round trip does without that: all records of its archives open with one WARC-Warcinfo-ID, drawn when they are
written, so no payload has it. Spark's text reader splits archives there, and a task holds a batch of records at most.

Ids are integers (cast to long). Defined results: null payloads are empty. Rows with equal id and payload are all
responses if their id is the smallest; null ids never are the smallest, unless all are null. A null url gives no
target field. Extra columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm.common import bounded_batches, fits, scratch, stored

#: No archive is larger, unless a single record is; and what a task puts together to a row.
ARCHIVE_BYTES, CHUNK_BYTES = 128 << 20, 8 << 20
#: More than what a record has besides its payload and its url.
HEAD_BYTES = 4096
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
EITHER = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FIELDS = ("warc-type", "warc-record-id", "content-length")
FOUND = pa.schema(
    [("archive", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("inner", pa.int64())]
    + [(n, pa.string()) for n in ("reason", "record_type", "record_id", "target_uri", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())]
)


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return b32encode(hashlib.sha1(data).digest()).decode()


def opening(info: str | None) -> bytes:
    """What a record opens with."""
    return b"WARC/1.1\r\n" + (f"WARC-Warcinfo-ID: <{info}>\r\n".encode() if info else b"")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, info: str | None = None) -> bytes:
    """The bytes of one record; a revisit if it refers to another page."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", re.sub(r"\s", "%20", url))] if url else []),
        *([] if refers_to is None else [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return opening(info) + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


class Found(NamedTuple):
    """A record, or a gap (with a reason).

    The bytes of a member count for its first record; ``inner`` is where a record starts in the member's plain bytes.
    """

    offset: int
    length: int
    reason: str | None
    fields: dict[str, str]
    payload: bytes
    payload_bytes: int
    inner: int | None = None


class Damaged(Exception):
    """A check failed; ``found`` has what could be read all the same."""

    def __init__(self, reason: str, found: tuple[Found, ...] = ()):
        super().__init__(reason)
        self.found = found


def parse(data: bytes, at: int) -> Found:
    """The record at an offset of plain bytes."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        raise Damaged("fields without an end")
    fields = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("a line that is no field")
        fields[name.strip().lower()] = value.strip()
    if not all(f in fields for f in FIELDS) or not fields["content-length"].isdecimal():
        raise Damaged("a field is missing")
    start, stop = end + 4, end + 4 + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("the block has another length")
    block = data[start:stop]
    if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"][5:] != digest(block):
        raise Damaged("block digest")
    head, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    size = len(payload)
    if fields["warc-type"] == "revisit":
        stated = re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)
        size = int(stated[1]) if stated else 0
    elif fields.get("warc-payload-digest", "").startswith("sha1:") and fields["warc-payload-digest"][5:] != digest(payload):
        raise Damaged("payload digest")
    return Found(at, stop + 4 - at, None, fields, payload, size)


def scan(data: bytes, signs: re.Pattern, read) -> Iterator[Found]:
    """Records that ``read(data, at)`` gives, with their end, one after another; and the gaps between them."""
    at, lost, reason = 0, 0, None
    while at < len(data):
        try:
            found, end = read(data, at)
        except Damaged as e:
            yield from e.found
            reason, sign = reason or str(e), signs.search(data, at + 1)
            at = sign.start() if sign else len(data)
            continue
        if lost < at:
            yield Found(lost, at - lost, reason, {}, b"", 0)
        yield from found
        at = lost = end
        reason = None
    if lost < len(data):
        yield Found(lost, len(data) - lost, reason, {}, b"", 0)


def plain_record(data: bytes, at: int) -> tuple[list[Found], int]:
    found = parse(data, at)
    return [found], at + found.length


def member_records(data: bytes, at: int) -> tuple[list[Found], int]:
    """The records of the gzip member at an offset, and the gaps between them."""
    member, parts, fed, step, reason = zlib.decompressobj(31), [], at, 1 << 16, None
    while not member.eof and fed < len(data):  # in pieces, as what is left over is copied
        before = member.copy()
        try:
            parts.append(member.decompress(data[fed : fed + step]))
            fed += step
        except zlib.error:
            if step == 16:
                reason = "gzip check"
                break
            member, step = before, step // 16  # a call that fails gives nothing: up to the break in smaller ones
    if not member.eof:
        reason = reason or "gzip member without an end"
    end = min(fed, len(data)) - len(member.unused_data)
    found = [x._replace(offset=at, length=0, inner=x.offset) for x in scan(b"".join(parts), VERSION, plain_record)]
    records = tuple(x for x in found if not x.reason)
    if reason or not records:
        raise Damaged(reason or "no record in a member", records)
    return [found[0]._replace(length=end - at), *found[1:]], end


def either(data: bytes, at: int) -> tuple[list[Found], int]:
    return (member_records if data.startswith(MEMBER, at) else plain_record)(data, at)


def salvage(data: bytes) -> Iterator[Found]:
    """All records that can be read from an archive, and the gaps between them, in order."""
    return scan(data, EITHER, either)


def payload_digests(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, digest, size) of every payload."""

    def digested(batches):
        for batch in batches:
            payloads = [x.as_py() or b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(digest, payloads), pa.string()), pa.array(map(len, payloads), pa.int64())], ["id", "digest", "size"]
            )

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(payload_col).cast("binary").alias("payload"))
    return rows.mapInArrow(digested, "id long, digest string, size long")


def write(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, info: str | None = None
) -> None:
    """Write archives of all pages to a folder; ``info`` is the WARC-Warcinfo-ID of their records."""
    bounded_batches(pages.sparkSession)
    known = stored(payload_digests(pages, id_col, payload_col), "digests")
    firsts = known.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = known.join(firsts.drop("n"), ["digest", "size"]).where("id is null or id > first").where("first is not null")
    repeats = stored(repeats.groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct("digest", "first")).alias("_refs")), "repeats")
    largest = known.agg(F.max("size")).first()[0] or 0
    if fits(repeats.count(), 256):
        repeats = F.broadcast(repeats)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).cast("binary").alias("payload"))
    rows = rows.join(repeats, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", "url", "payload", "_refs")
    chunk = CHUNK_BYTES

    def made(batches):
        held, size = [], 0

        def put_together():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])  # the writer adds the line feed

        for batch in batches:
            for i, url, payload, refs in zip(*(c.to_pylist() for c in batch.columns)):
                payload = payload or b""
                refers_to = {r["digest"]: r["first"] for r in refs}.get(digest(payload)) if refs else None
                new = record(i, url, payload, refers_to, info)
                if held and size + len(new) > chunk:
                    yield put_together()
                    held, size = [], 0
                held.append(new)
                size += len(new)
        if held:
            yield put_together()

    bytes_of = F.coalesce(F.octet_length("payload"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) + HEAD_BYTES
    small = (F.lit(True) if largest + HEAD_BYTES <= chunk else bytes_of <= chunk, max(1, ARCHIVE_BYTES // chunk))
    parts = [small] if largest + HEAD_BYTES <= chunk else [small, (bytes_of > chunk, max(1, ARCHIVE_BYTES // (largest + HEAD_BYTES)))]
    for which, per_file in parts:
        records = rows.where(which).mapInArrow(made, "value binary").select(F.col("value").cast("string").alias("value"))
        records.write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


def read(spark: SparkSession, path: str, with_payload: bool = False, info: str | None = None) -> DataFrame:
    """Every record and gap of the archives in a folder.

    A gap has a reason and no record fields. Columns: archive, start, length, inner, reason, record_type, record_id,
    target_uri, payload_digest, payload_bytes, refers_to, payload (null unless asked for). With ``info``, that of plain
    archives that were written with it, tasks share an archive; they don't know where in it they start, so start is null.
    """
    bounded_batches(spark)
    begin = opening(info) if info else b""

    def rows(archive: str, data: bytes) -> Iterator[tuple]:
        for x in salvage(data):
            f = x.fields
            stated = f.get("warc-payload-digest", "").removeprefix("sha1:")
            yield (
                archive, None if begin else x.offset, x.length, x.inner, x.reason, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"),
                None if x.reason else stated or digest(x.payload), None if x.reason else x.payload_bytes, f.get("warc-refers-to"),
                x.payload if with_payload and not x.reason else None,
            )

    def salvaged(batches):
        for batch in batches:
            out = []
            for archive, data in zip(batch.column(0), batch.column(1)):
                for row in rows(archive.as_py(), begin + data.as_py()):
                    out.append(row)
                    if len(out) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)

    kinds = "archive string, start long, length long, inner long, reason string, record_type string, record_id string, target_uri string, payload_digest string"
    if info:
        texts = spark.read.option("lineSep", begin.decode()).text(path)
        files = texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("content")).where(F.octet_length("content") > 0)
    else:
        files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(salvaged, kinds + ", payload_bytes long, refers_to string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write archives to a new shared folder and read them back."""
    path, info = scratch(pages.sparkSession, "warc"), f"urn:uuid:{uuid.uuid4()}"
    write(pages, path, id_col, url_col, payload_col, least, info)
    return read(pages.sparkSession, path, info=info)
