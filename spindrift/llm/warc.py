"""Operator 2, WARC: archives of web records packaged in ZIP files, written and read by Spark tasks.

A writing task streams its rows into ZIP files of stored members: archive/data.warc.gz with the records, each compressed by itself as such archives do, and
indexes/index.cdxj with a line (offset, length, record id) for each. A file gets its name only when it is whole, and
the manifest of finished files is kept as a table, so that a task that runs again leaves no record twice. The reader
parses the end record, the ZIP64 records and the central directory, locates the stored members, reads the index and
fetches the records by ranges; nothing is extracted.

Defined results: a null html is an empty payload; of equal payloads the largest page_id is the response (rows that
repeat both are all responses, and so is a row without page_id whose payload no other row has); an empty table gives
no archives and no rows; other columns are ignored. Memory of a task: one archive's index and one range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored, table

RECORDS = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
MANIFEST = "path string, records long, bytes long"
READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> tuple[str, bytes]:
    """(record id, bytes) of one WARC record. A revisit keeps the HTTP head, whose Content-Length is the payload's."""
    name = f"<urn:page:{'' if page_id is None else page_id}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Length: {len(block)}")
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """One ZIP file with a member of records and a member with their index."""

    def __init__(self, folder: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"pages-{uuid.uuid4().hex}.zip"
        self.folder, self.part, self.path = folder, f"{root}/.{self.name}.part", f"{root}/{self.name}"
        self.out = self.fs.open_output_stream(self.part)
        self.buffer = io.BufferedWriter(_Sink(self.out), 1 << 20)
        self.zip = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(RECORDS, "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, name: str, data: bytes) -> None:
        data = gzip.compress(data, 1, mtime=0)
        self.member.write(data)
        self.index.append(json.dumps({"offset": self.at, "length": len(data), "id": name}))
        self.at += len(data)

    def close(self) -> dict:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        self.buffer.flush()
        self.out.close()
        self.fs.move(self.part, self.path)
        return {"path": f"{self.folder}/{self.name}", "records": len(self.index), "bytes": self.at}


class _Sink(io.RawIOBase):
    """A write-only stream without seeking, so that zipfile puts sizes behind the data and into the directory."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def write_archives(pages: DataFrame, folder: str, archive_records: int = 20_000, archive_bytes: int = 256 << 20) -> DataFrame:
    """Writes the archives of (page_id, url, html) and returns their manifest, kept as a table."""
    digest = F.sha1(F.coalesce("html", F.lit("")))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), digest.alias("digest"))
    keys = pages.select("page_id", digest.alias("digest"))
    first = keys.groupBy("digest").agg(F.max("page_id").alias("first"))
    # Decisions are a few bytes a row and are joined by page, so the pages themselves move once and evenly.
    choice = keys.distinct().join(first, "digest").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first")
    rows = rows.join(choice, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    revisit = ~F.coalesce(F.col("page_id").eqNullSafe(F.col("first")), F.lit(True))
    rows = rows.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"))

    def write(batches):
        out = None
        for batch in batches:
            for page_id, url, html, sha, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = ArchiveWriter(folder)
                out.add(*record(page_id, url, html.encode(), base32(sha), refers_to))
                if len(out.index) >= archive_records or out.at >= archive_bytes:
                    yield pa.RecordBatch.from_pylist([out.close()], manifest_schema)
                    out = None
        if out is not None:
            yield pa.RecordBatch.from_pylist([out.close()], manifest_schema)

    manifest_schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    return stored(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """name -> (offset of the data, length) of the stored members of a ZIP file, from its central directory."""
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack("<H2I", tail[end + 10 : end + 20])
    locator = tail_at + end - 20
    if locator >= 0 and (raw := file.read_at(20, locator))[:4] == b"PK\x06\x07":
        record64 = file.read_at(56, struct.unpack("<Q", raw[8:16])[0])
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where the locator points")
        count, length, at = struct.unpack("<3Q", record64[32:56])
    directory, found, p = file.read_at(length, at), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, packed, plain = (struct.unpack("<H", directory[p + 10 : p + 12])[0], *struct.unpack("<2I", directory[p + 20 : p + 28]))
        n, m, k = struct.unpack("<3H", directory[p + 28 : p + 34])
        offset = struct.unpack("<I", directory[p + 42 : p + 46])[0]
        name = directory[p + 46 : p + 46 + n].decode()
        extra, q = directory[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            kind, ln = struct.unpack("<2H", extra[q : q + 4])
            if kind == 1:  # ZIP64: 8 bytes for each field that is all ones above, in this order
                wide = iter(struct.unpack(f"<{ln // 8}Q", extra[q + 4 : q + 4 + ln // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            q += 4 + ln
        p += 46 + n + m + k
        if method == 0:
            local = file.read_at(30, offset)
            found[name] = (offset + 30 + sum(struct.unpack("<2H", local[26:30])), plain)
    return found


def parse(data: bytes) -> dict:
    """The fields of READ from one record's bytes, compressed or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record where the index points")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    number = lambda x: int(n) if (n := x[10:-1]) else None  # noqa: E731  <urn:page:N>
    out = {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
           "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
           "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:")}
    if out["record_type"] == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["payload_digest"]:
            raise ValueError(f"the payload of {fields['warc-record-id']} doesn't match its digest")
        return out | {"payload_bytes": len(payload), "payload": payload}
    sizes = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return out | {"payload_bytes": int(sizes["content-length"]), "payload": None}


def read_archives(manifest: DataFrame, with_payload: bool = True, range_bytes: int = 4 << 20) -> DataFrame:
    """The records of the archives that the manifest's column path names: READ's columns."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in READ.split(", "))])

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as file:
                    found = members(file, file.size())
                    start, length = found[INDEX]
                    index = [json.loads(x) for x in file.read_at(length, start).decode().split("\n") if x]
                    base, group, rows = found[RECORDS][0], [], []
                    for i, x in enumerate(index):
                        group.append(x)
                        if i + 1 < len(index) and x["offset"] + x["length"] - group[0]["offset"] < range_bytes:
                            continue
                        first = group[0]["offset"]
                        data = file.read_at(x["offset"] + x["length"] - first, base + first)
                        rows = [parse(data[g["offset"] - first : g["offset"] - first + g["length"]]) for g in group]
                        if not with_payload:
                            rows = [r | {"payload": None} for r in rows]
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        group = []

    spread = manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")
    return spread.mapInArrow(read, READ)


def op2_warc(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = write_archives(pages, scratch(spark, "warc"))
    return read_archives(manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT page_id, hex, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY hex) AS first_id,
         array_to_string(list_transform(range(1, 41), lambda i:
           lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS bits FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         list_sum(list_transform(range(0, 5), lambda j: CASE WHEN bits[i * 5 + j + 1] = '1' THEN 1 << (4 - j) ELSE 0 END))::INT + 1]), '')
         AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""
