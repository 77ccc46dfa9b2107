"""WARC archives: a writer, and a reader that salvages damaged archives.

The writer makes one gzip member per record (or plain records) and fills archives of
bounded size; Spark's text sink writes the bytes, one archive per file. Of records with
equal payloads the one with the largest key is a response, the others are revisits that
name it. Zero bytes may pad the end of an archive, as gzip allows.

The reader goes from record to record. Where a check fails (gzip data or checksum,
version line, length, end of record, block digest), it searches for the next gzip magic
or version line from which a valid record can be read, and logs the bytes between as a
quarantined gap. Inside a member that can be unpacked, in whole or up to some byte, it searches
for version lines in the same way; its gap names the bytes lost inside. An archive is one
value of a task; its records leave the task in small batches.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.common import new_folder, pieces

ARCHIVE = 8 << 20  # bytes after which an archive is closed
LEAST_REVISIT = 1000  # bytes of a payload worth a revisit record
URN = "urn:orderlens:record:"
START = re.compile(rb"\x1f\x8b\x08|WARC/\d")
VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header of the block."""
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def http_length(self) -> int:
        """The payload's length as the HTTP header gives it."""
        found = re.search(rb"(?im)^content-length:\s*(\d+)", self.block.partition(b"\r\n\r\n")[0])
        return int(found[1]) if found else len(self.payload)

    def key(self, name: str) -> str | None:
        value = self.headers.get(name)
        return value[len(URN) + 1 : -1] if value and value.startswith(f"<{URN}") else None


@dataclass
class Reading:
    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)  # start, end, reason


def same_digest(named: str, block: bytes) -> bool:
    """Whether a digest header fits, in hex or base32; others than SHA-1 are not checked."""
    kind, _, value = named.partition(":")
    if kind.lower() != "sha1":
        return True
    real = hashlib.sha1(block).digest()
    return value.strip().lower() in (real.hex(), base64.b32encode(real).decode().lower())


def build(key: object, uri: str | None, payload: bytes, digest: str, refers: object) -> bytes:
    """One record as bytes; a revisit if ``refers`` is given, then without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if key is None else key}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + re.sub(r"\s", "%20", uri or "about:blank"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <{URN}{refers}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """The record as a gzip member of its own."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def parse(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """(record, end, "") of the plain record at ``at``, or (None, at, reason)."""
    if not VERSION.match(data, at):
        return None, at, "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None, at, "no end of header"
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.decode("latin-1").strip()] = value.decode("utf-8", "replace").strip()
    size = headers.get("Content-Length", "")
    if not size.isdigit():
        return None, at, "no length"
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, at, "no end of record"
    block = data[start:stop]
    if not same_digest(headers.get("WARC-Block-Digest", ""), block):
        return None, at, "block digest"
    return Record(headers, block), stop + 4, ""


def _plain_run(data: bytes) -> tuple[list[Record], str]:
    """The records of unpacked bytes, and what was lost between them."""
    out, at, lost, why, gaps = [], 0, None, "", []
    while at < len(data):
        record, end, reason = parse(data, at)
        if record is None:
            if lost is None:
                lost, why = at, reason
            following = VERSION.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if lost is not None:
            gaps.append((lost, at, why))
            lost = None
        out.append(record)
        at = end
    if lost is not None:
        gaps.append((lost, at, why))
    return out, "; ".join(f"bytes {a} to {b}: {reason}" for a, b, reason in gaps)


def _before_damage(data: bytes, at: int) -> bytes:
    """What can be unpacked of a damaged member, up to the byte that fails."""
    unzip, plain = zlib.decompressobj(31), bytearray()
    for start in range(at, len(data), 1 << 14):
        saved, part = unzip.copy(), data[start : start + (1 << 14)]
        try:
            plain += unzip.decompress(part)
        except zlib.error:
            try:
                for i in range(len(part)):
                    plain += saved.decompress(part[i : i + 1])
            except zlib.error:
                break
        if unzip.eof:
            break
    return bytes(plain)


def _step(data: bytes, at: int) -> tuple[list[Record], int, str]:
    """(records, end, reason): what can be read at ``at``; without a reason all is well."""
    if data[at : at + 2] != b"\x1f\x8b":
        record, end, reason = parse(data, at)
        return ([record] if record else []), end, reason
    unzip, plain, taken = zlib.decompressobj(31), bytearray(), at
    try:
        while not unzip.eof and taken < len(data):
            part = data[taken : taken + (1 << 16)]
            plain += unzip.decompress(part)
            taken += len(part)
    except zlib.error:
        return _plain_run(_before_damage(data, at))[0], at, "gzip data"
    if not unzip.eof:
        return _plain_run(bytes(plain))[0], at, "gzip member cut short"
    records, reason = _plain_run(bytes(plain))
    return records, taken - len(unzip.unused_data), reason and f"in member: {reason}"


def found(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """All records that can be read, in order, and the gaps (start, end, reason)."""
    at, lost, why = 0, None, ""
    while at < len(data):
        if lost is None and data[at] == 0:  # padding
            padded = at
            while padded < len(data) and data[padded] == 0:
                padded += 1
            if padded == len(data):
                break
        records, end, reason = _step(data, at)
        if lost is not None and (records or not reason):
            yield lost, at, why
            lost = None
        yield from records
        if not reason:
            at = end
            continue
        if lost is None:
            lost, why = at, reason
        following = START.search(data, end if end > at else at + 1)
        at = following.start() if following else len(data)
    if lost is not None:
        yield lost, len(data), why


def salvage(data: bytes) -> Reading:
    """The records and the gaps of an archive."""
    out = Reading()
    for item in found(data):
        (out.records if isinstance(item, Record) else out.gaps).append(item)
    return out


def write(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    gzip: bool = True,
) -> None:
    """Write one record per row as archives in ``folder``; a null payload is empty.

    Rows with an equal payload of at least LEAST_REVISIT bytes refer to the largest key
    among them; rows that repeat that key are responses too. A null key refers like any
    other, and is never the largest while there is another. Other columns are not
    looked at.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    plain = pages.select(
        F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), body.alias("body")
    ).withColumn("digest", F.sha1(F.col("body").cast("binary")))
    copies = (
        plain.filter(F.octet_length("body") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("key").alias("largest"))
        .filter("n > 1 and largest is not null")
        .select("digest", "largest")
    )
    refers = F.when(~F.col("largest").eqNullSafe(F.col("key")), F.col("largest"))
    rows = plain.join(copies, "digest", "left").select(
        "key", "uri", "body", "digest", refers.alias("refers")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

        for batch in pieces(batches, 64):
            for k, u, b, d, r in zip(*(c.to_pylist() for c in batch.columns)):
                record = build(k, u, b.encode("utf-8", "surrogatepass"), d, r)
                # The sink ends each file itself: zero padding, or the end of the last record.
                record = member(record) if gzip else record
                held.append(record)
                size += len(record)
                if size >= ARCHIVE:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    archives = rows.mapInArrow(run, "archive binary")
    end = "\u0000" if gzip else "\r\n\r\n"
    bare = "archive" if gzip else "substring(archive, 1, octet_length(archive) - 4)"
    (
        archives.select(F.expr(bare).cast("string").alias("value"))
        .write.option("lineSep", end)
        .option("maxRecordsPerFile", 1)
        .text(folder)
    )


def read_archives(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of all archives in a folder, gzip or plain.

    records: path, position, key, record_type, refers_to, uri, payload_bytes,
    payload_digest, payload. A revisit has its digest and length from its headers and a
    null payload; a response's are computed from the payload, and where its header
    names another digest, the record is in gaps. gaps: path, start, end, reason; what
    fails within a readable record has its position as start and no end.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    schema = (
        "path string, position bigint, key string, record_type string, refers_to string, "
        "uri string, payload_bytes bigint, payload_digest string, payload binary, "
        "start bigint, end bigint, reason string"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
    kinds += [pa.int64(), pa.int64(), pa.string()]

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        position = -1
        for item in found(data):
            if not isinstance(item, Record):
                yield (path, *[None] * 8, *item)
                continue
            position += 1
            kind = item.headers.get("WARC-Type", "")
            named = item.headers.get("WARC-Payload-Digest", "")
            size, body, digest = item.http_length, None, named.removeprefix("sha1:")
            if kind != "revisit":
                body = item.payload
                if not same_digest(named, body):
                    yield (path, *[None] * 8, position, None, "payload digest")
                    continue
                size, digest = len(body), hashlib.sha1(body).hexdigest()
            about = item.key("WARC-Record-ID"), kind, item.key("WARC-Refers-To")
            uri = item.headers.get("WARC-Target-URI")
            yield (path, position, *about, uri, size, digest, body, *[None] * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            every = rows(batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            while part := list(itertools.islice(every, 64)):
                columns = [pa.array(c, k) for c, k in zip(zip(*part), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    every = files.mapInArrow(run, schema)
    records = every.filter("reason is null").select(*names[:9])
    return records, every.filter("reason is not null").select("path", *names[9:])


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write(pages, folder)
    records, gaps = read_archives(spark, folder)
    lost = gaps.agg(F.count("*").alias("n"), F.min("reason").alias("reason")).first()
    if lost["n"]:
        raise RuntimeError(f"{lost['n']} gaps in archives just written, such as: {lost['reason']}")
    kind = pages.schema["page_id"].dataType
    return records.select(
        F.when(F.col("key") != "", F.col("key")).cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


ORACLE = """
SELECT page_id,
       CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       sha1(body) AS payload_digest,
       CASE WHEN largest IS NULL OR largest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN largest = page_id THEN NULL ELSE largest END AS refers_to
FROM (
  SELECT page_id, body,
         CASE WHEN octet_length(encode(body)) >= 1000
              THEN max(page_id) OVER (PARTITION BY body) END AS largest
  FROM (SELECT page_id, coalesce(html, '') AS body FROM pages)
)
"""
