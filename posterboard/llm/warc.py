"""WARC: a writer of archives and a splittable reader.

Every record is a gzip member of its own. The reader's tasks each take a byte range of a file, look for the gzip magic,
take a place as a member only if its first bytes inflate to a WARC header, and own the records that start inside their range;
the last of them is read beyond the range's end. So a file's size doesn't limit how many tasks read it.

Archives lie in the shared folder and are opened through pyarrow.fs, which knows local, HDFS, S3 and GCS addresses.
A file gets its name from the task attempt, and only the files that finished tasks report are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, fresh_path, table, written

MAGIC = b"\x1f\x8b\x08"
#: A new archive begins after so many bytes.
FILE_BYTES = 64 << 20
#: A reading task's byte range.
SPLIT_BYTES = 4 << 20
MAX_READ_TASKS = 100_000
#: Payloads of at least so many bytes become revisits of an equal payload.
MIN_REVISIT_BYTES = 0
LEVEL = 5
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    return "<urn:x-page:" + ("" if page_id is None else str(int(page_id))) + ">"


def _page_id(record_id: str | None) -> int | None:
    found = re.search(r"urn:x-page:(-?\d+)", record_id or "")
    return int(found[1]) if found else None


def write_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, and so the payload's size, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else _record_id(page_id)[1:-1]
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[7:7] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def plan_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds refers_to: the smallest page_id among equal payloads of at least min_bytes; null where the row is that page.

    Payloads are compared by SHA-1 and length, whole, however long they are; null is empty. Rows with one page_id and one payload are all responses. A column named refers_to is replaced, all others stay.
    """
    pages = pages.drop("refers_to")
    sha1, size, first = (free_name(pages, c) for c in ("_sha1", "_bytes", "_first"))
    pages = pages.withColumns({sha1: F.sha1(F.coalesce("html", F.lit("")).cast("binary")), size: F.coalesce(F.octet_length("html"), F.lit(0))})
    firsts = pages.where(F.col(size) >= min_bytes).groupBy(sha1, size).agg(F.min("page_id").alias(first), F.count(F.lit(1)).alias("_n"))
    firsts = firsts.where("_n > 1").drop("_n")
    return pages.join(firsts, [sha1, size], "left").withColumn(
        "refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col(first)), F.col(first))
    ).drop(sha1, size, first)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """pages: page_id, url, html (null: empty payload), refers_to. Writes archives into folder; returns path, bytes, records of each."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, size, records, path = None, 0, 0, ""
        for pdf in batches:
            for page_id, url, html, refers_to in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                if out is None:
                    path, size, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                payload = (html or "").encode("utf-8")
                member = write_record(page_id, url, payload, payload_digest(payload), refers_to, refers_to is not None)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= FILE_BYTES:
                    out.close()
                    yield pd.DataFrame({"path": [path], "bytes": [size], "records": [records]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [records]})

    rows = pages.select("page_id", "url", "html", "refers_to").withColumns({c: F.col(c).cast("decimal(20,0)").cast("string") for c in ("page_id", "refers_to")})
    return written(rows.mapInPandas(write, "path string, bytes long, records long"), "warc-manifest")


def _header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class _Window:
    """Bytes of a file from a place on, read as they are needed."""

    def __init__(self, file, size: int, start: int, ahead: int = 1 << 20):
        self.file, self.size, self.base, self.data, self.ahead = file, size, start, b"", ahead

    def upto(self, end: int) -> None:
        if (have := self.base + len(self.data)) < (end := min(end, self.size)):
            self.file.seek(have)
            self.data += self.file.read(min(max(end - have, self.ahead), self.size - have))

    def drop(self, at: int) -> None:
        self.data, self.base = self.data[at - self.base :], at


def _inflate(w: _Window, at: int, most: int | None = None) -> tuple[bytes, int] | None:
    """The member at that place and where it ends, or about its first ``most`` bytes; None if it's no gzip data."""
    z, out, place = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            w.upto(place + 1)
            part = w.data[place - w.base : place - w.base + (4096 if most else 1 << 20)]
            if not part:
                return (b"".join(out), place) if most else None
            out.append(z.decompress(part, most) if most else z.decompress(part))
            place += len(part) - len(z.unused_data)
            if most:
                break
    except zlib.error:
        return None
    return b"".join(out), place


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, record) of each member that starts in [start, end)."""
    w, at = _Window(file, size, start), start
    while at < end:
        w.upto(min(end, at + (1 << 16)) + len(MAGIC) - 1)
        here = w.data.find(MAGIC, at - w.base)
        if here < 0:
            at = max(at + 1, w.base + len(w.data) - len(MAGIC) + 1)
            w.drop(min(at, w.base + len(w.data)))
            continue
        at = w.base + here
        if at >= end:
            return
        peek = _inflate(w, at, 64)
        whole = _inflate(w, at) if peek and peek[0].startswith(b"WARC/1.") else None
        if whole is None:
            at += 1
            continue
        yield at, whole[0]
        at = whole[1]
        w.drop(at)


RECORD = "path string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string"


def read_archives(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """files: path, bytes. Returns a row per record; of a revisit the payload is null, and size and digest are the full payload's.

    A response's size and digest are taken from the payload that was read, and it is an error if the header's digest differs.
    An empty list of files, or a file without members, gives no rows. A record is held whole while it is read, however long; other columns of files are ignored.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _filesystem(folder)
        for pdf in batches:
            for path, size, start in zip(pdf["path"], pdf["bytes"], pdf["start"], strict=True):
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for at, raw in records_in(f, int(size), int(start), min(int(size), int(start) + split_bytes)):
                        head, _, rest = raw.partition(b"\r\n\r\n")
                        h = _header(head)
                        block = rest[: int(h["content-length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit, digest = h["warc-type"] == "revisit", h["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and payload_digest(payload) != digest:
                            raise ValueError(f"{path} at {at}: the payload's digest isn't the header's")
                        n = int(_header(http)["content-length"]) if revisit else len(payload)
                        rows.append((path, at, h["warc-record-id"], h["warc-type"], h["warc-target-uri"], h.get("warc-refers-to"), None if revisit else payload, n, digest))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in RECORD.split(", ")]
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    # a stated number of partitions: small rows that stand for much work must not be put together
    parts = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return ranges.repartition(min(int(parts), MAX_READ_TASKS), "path", "start").mapInPandas(read, RECORD)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    files = write_archives(plan_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html")), folder)
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, 'urn:x-page:(-?[0-9]+)', 1), '') AS BIGINT)")
    return read_archives(files, folder).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"),
    )
