"""WARC archives: one gzip member per record, read back sequentially.

The reader inflates incrementally, finds member ends from the decompressor itself, frames each record's block by
its Content-Length and verifies block and payload digests. Archives are rows of bytes in the shared folder, so no
executor needs another's disk.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Payloads from this size on are stored once, other records of the same payload refer to it.
REVISIT_BYTES = 1000
#: Bytes of one archive, about; a longer record makes a longer archive.
ARCHIVE_BYTES = 4 << 20
#: Bytes fed to the decompressor at once.
CHUNK = 1 << 16
#: The record date, as archives must be equal in reruns, and the header of every stored response.
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def _line(value: str) -> str:
    """A header value on one line: control characters as their percent code."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def write_record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """The gzip member of a response record, or of a revisit record where ``refers_to`` is given."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: {digest(payload)}", f"WARC-Block-Digest: {digest(block)}"]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", f"X-Payload-Length: {len(payload)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def read_records(archive: bytes, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in turn. Raises ValueError for a cut member, a wrong frame or a wrong digest."""
    at = 0
    while at < len(archive):
        z, out = zlib.decompressobj(31), bytearray()
        while not z.eof:
            data = archive[at : at + chunk]
            if not data:
                raise ValueError("the archive ends within a member")
            at += len(data)
            try:
                out += z.decompress(data)
            except zlib.error as e:
                raise ValueError(f"not a gzip member: {e}") from e
        at -= len(z.unused_data)
        yield _framed(bytes(out))


def _framed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    block = body[:size]
    if len(block) != size or body[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is not its Content-Length")
    if headers["WARC-Block-Digest"] != digest(block):
        raise ValueError("the block digest is wrong")
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != digest(payload_of(block)):
        raise ValueError("the payload digest is wrong")
    return headers, block


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (``id_col``, url, ``payload_col``) with ``refers_to``: the largest id of an equal payload of ``least``
    bytes or more, null for that row itself. Only digests are grouped, so a payload that a third of all pages share
    is one partial row per task; pages join by digest in narrow rows and by their own id with their payload."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    narrow = pages.where(F.octet_length(payload) >= least).select(F.col(id_col).alias("_id"), F.sha1(payload).alias("_sha"))
    firsts = narrow.groupBy("_sha").agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    # Stored, so that the join has a shuffle of its own on both sides, which Spark can split at a hot digest.
    firsts = stored(firsts, "warc-firsts")
    links = narrow.join(firsts, "_sha").where("_id is null or _id <> _first").select("_id", "_sha", "_first").distinct()
    keyed = pages.withColumn("_sha_own", F.when(F.octet_length(payload) >= least, F.sha1(payload)))
    return keyed.join(links, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_sha_own") == F.col("_sha")), "left").select(*pages.columns, F.col("_first").alias("refers_to"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (archive string, content binary) of all ``pages``, stored in the shared folder.

    A null payload is stored as the empty one. Rows equal in id and payload are all responses if theirs is the
    largest id, else all revisits. An empty table gives no archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            for page_id, url, html, first in zip(*batch.columns, strict=True):
                member = write_record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), first.as_py())
                members.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield _archive(members)
                    members, size = [], 0
        if members:
            yield _archive(members)

    rows = revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col)
    return stored(rows.mapInArrow(write, "archive string, content binary"), "warc")


def _archive(members: list[bytes]) -> pa.RecordBatch:
    content = b"".join(members)
    name = f"{hashlib.sha1(content).hexdigest()}.warc.gz"
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record: archive, page_id, url, payload_bytes, payload_digest (bare hexadecimal SHA-1 of the full
    payload), record_type, refers_to, and with ``with_payload`` the payload (null for a revisit)."""
    fields = [("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    if with_payload:
        fields.append(("payload", pa.binary()))
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for headers, block in read_records(content.as_py()):
                    revisit = headers["WARC-Type"] == "revisit"
                    payload = None if revisit else payload_of(block)
                    sha1 = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    number = lambda k: int(headers[k]) if k in headers else None  # noqa: B023, E731
                    row = [name.as_py(), number("X-Page-ID"), headers.get("WARC-Target-URI"), number("X-Payload-Length") if revisit else len(payload), sha1, headers["WARC-Type"], number("X-Refers-To-Page-ID")]
                    rows.append(row + [payload] * with_payload)
                    size += len(payload or b"") if with_payload else 0
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kinds = "archive string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    return archives.mapInArrow(read, kinds)


def op1_warc(spark, sf_dir):
    """Contract query: writes a record for every row of ``pages`` and returns what is read back; see ``write_archives`` and
    ``read_archives`` for nulls, ties, repeated rows and empty tables."""
    from .common import load

    return read_archives(write_archives(load(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes, sha1(payload) as payload_digest from p),
f as (select *, max(case when payload_bytes >= 1000 then page_id end) over (partition by payload_digest, payload_bytes) as first from d)
select page_id, payload_bytes, payload_digest,
       case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to
from f
"""
