"""WARC archives: a writer of gzip members, one a record, and a splittable reader.

The reader's tasks own byte ranges, not files. A task searches its range for the gzip magic, takes an offset as a
record only if the member there decodes to a WARC version line and a complete header, reads each record that starts
inside its range to its end (beyond the range's end if need be), and resumes behind it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.skew import join_per_key
from plumbline.storage import scratch_path, table

#: Records of equal payloads at least so long are stored once and revisited.
MIN_REVISIT_BYTES = 0
#: Bytes of an archive that one task owns.
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"


def _open(path: str):
    """(filesystem, path in it) for a URI or a plain path; the names that Hadoop has for S3 are read as s3."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    path = f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else path
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    """Hadoop writes file:/x where URIs have file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _line(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, revisit, refers_to) -> bytes:
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"page {page_id} {digest} {url}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def _write(batches, folder: str):
    """One archive a task: written under the attempt's own name, then moved to the partition's name."""
    task = TaskContext.get()
    files, root = _open(folder)
    final = f"{root}/part-{task.partitionId():06d}.warc.gz"
    draft = f"{root}/.{task.partitionId():06d}-{task.taskAttemptId()}.tmp"
    records = size = 0
    with files.open_output_stream(draft, compression=None) as out:
        for pdf in batches:
            for page_id, url, html, refers_to, revisit in zip(
                pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], pdf["revisit"], strict=True
            ):
                page_id = None if pd.isna(page_id) else int(page_id)
                refers_to = None if pd.isna(refers_to) else int(refers_to)
                data = _record(page_id, url, (html or "").encode(), bool(revisit), refers_to)
                out.write(data)
                records += 1
                size += len(data)
    files.move(draft, final)
    yield pd.DataFrame({"path": [f"{folder}/part-{task.partitionId():06d}.warc.gz"], "bytes": [size], "records": [records]})


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; returns (path, bytes, records).

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of at least ``min_revisit_bytes``
    bytes the one with the largest page_id is a response and the others revisit it; rows that share that page_id are
    all responses, as are rows of a payload of which no page_id is known. A null url is left out, control characters
    and blanks in one are percent-encoded. Only files named in the result belong to the archive.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")
    ).withColumn("digest", F.sha1("html"))
    held = F.octet_length("html") >= min_revisit_bytes
    first = rows.where(held).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    # A payload that many pages share is looked up where its pages are; they are not gathered in one task.
    total = pages.count()
    known = join_per_key(rows.where(held), first, "digest", "n", total)
    rows = known.unionByName(rows.where(~held).withColumn("refers_to", F.lit(None).cast("long")))
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    rows = rows.select("page_id", "url", "html", "refers_to", revisit.alias("revisit"))
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    listing = rows.mapInPandas(lambda batches: _write(batches, folder), "path string, bytes long, records long")
    spark = pages.sparkSession
    manifest = scratch_path(spark, "warc-manifest")
    listing.write.parquet(manifest)
    return spark.read.schema(listing.schema).parquet(manifest)


class _Bytes:
    """A file's bytes from an offset on, read in pieces."""

    def __init__(self, stream, start: int, size: int):
        self.stream, self.start, self.size, self.data = stream, start, size, b""

    def at(self, offset: int, length: int) -> bytes:
        """Up to ``length`` bytes from ``offset``; offsets never go back beyond what ``drop`` has left."""
        while offset + length > self.start + len(self.data) < self.size:
            self.stream.seek(self.start + len(self.data))
            more = self.stream.read(min(READ_BYTES, self.size - self.start - len(self.data)))
            if not more:
                break
            self.data += more
        return self.data[offset - self.start : offset - self.start + length]

    def find_magic(self, offset: int, end: int) -> int:
        """The first offset of the magic from ``offset`` on and before ``end``, or -1."""
        while offset < end:
            piece = self.at(offset, min(READ_BYTES, end - offset) + len(MAGIC) - 1)
            found = piece.find(MAGIC)
            if found >= 0:
                return offset + found if offset + found < end else -1
            if len(piece) < len(MAGIC):
                return -1
            offset += len(piece) - len(MAGIC) + 1
            self.drop(offset)
        return -1

    def drop(self, offset: int) -> None:
        if offset > self.start:
            self.data, self.start = self.data[offset - self.start :], offset


def _member(source: _Bytes, offset: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at ``offset`` if it is a whole WARC record, else None."""
    inflate = zlib.decompressobj(31)
    out, at = [], offset
    try:
        while not inflate.eof:
            piece = source.at(at, READ_BYTES // 8)
            if not piece:
                return None
            out.append(inflate.decompress(piece))
            at += len(piece)
            if len(out) == 1 and not out[0].startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    return b"".join(out), at - len(inflate.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if _}


def _read_range(path: str, start: int, end: int):
    """The records of ``path`` that start from ``start`` on and before ``end``."""
    files, inside = _open(path)
    size = files.get_file_info(inside).size
    with files.open_input_file(inside) as stream:
        source = _Bytes(stream, start, size)
        offset = source.find_magic(start, end)
        while offset >= 0:
            got = _member(source, offset)
            if got is None:
                offset = source.find_magic(offset + 1, end)
                continue
            content, after = got
            head, _, block = content.partition(b"\r\n\r\n")
            fields = _fields(head)
            block = block[: int(fields.get("content-length", len(block)))]
            http, _, payload = block.partition(b"\r\n\r\n")
            yield fields, _fields(http), payload, offset
            source.drop(after)
            offset = source.find_magic(after, end)


COLUMNS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "payload binary, path string, record_offset long, intact boolean"
)


def _read(batches):
    for pdf in batches:
        for path, start, end in zip(pdf["path"], pdf["start"], pdf["end"], strict=True):
            rows, held = [], 0
            for fields, http, payload, offset in _read_range(path, int(start), int(end)):
                page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                kind = fields.get("warc-type")
                stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                size, digest, intact = len(payload), _digest(payload), None
                if kind == "revisit":  # the payload is elsewhere; what the writer knew of it
                    size, digest = int(http.get("content-length", 0)), stated
                else:
                    intact = digest == stated and size == int(http.get("content-length", size))
                rows.append(
                    (
                        None if page is None else int(page),
                        fields.get("warc-target-uri"),
                        size,
                        digest,
                        kind,
                        None if refers is None else int(refers),
                        None if kind == "revisit" else payload,
                        path,
                        offset,
                        intact,
                    )
                )
                held += len(payload)
                if held > READ_BYTES * 16:
                    yield _frame(rows)
                    rows, held = [], 0
            if rows:
                yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def read_warc(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of ``archives`` (path, bytes), by tasks that own ``split_bytes`` of a file each.

    Bytes that are no WARC record are passed over; an empty archive gives no rows. payload_bytes and payload_digest
    are counted from a response's payload, and ``intact`` says whether its headers agree; for a revisit they are those that
    its headers give for the full payload, payload and ``intact`` are null.
    """
    ranges = archives.select(
        "path",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias(
            "start"
        ),
    ).withColumn("end", F.col("start") + split_bytes)
    tasks = max(1, ranges.count())
    return ranges.repartition(tasks, "path", "start").mapInPandas(_read, COLUMNS)


def op8_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """Archives of all ``pages``, written and read back."""
    archives = write_warc(table(spark, sf_dir, "pages"), _uri(scratch_path(spark, "warc")))
    return read_warc(spark, archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


#: Base32 is spelled out from the digest's bits, five at a time.
OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS top FROM p
), n AS (
  SELECT *, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(hex, CAST(i AS BIGINT), 1)) - 1) AS h FROM d
), b AS (
  SELECT *, flatten(list_transform(h, lambda x: [x // 8 % 2, x // 4 % 2, x // 2 % 2, x % 2])) AS bits FROM n
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + bits[i*5+1]*16 + bits[i*5+2]*8 + bits[i*5+3]*4 + bits[i*5+4]*2 + bits[i*5+5] AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b
"""
