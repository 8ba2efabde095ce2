"""WARC records in ZIP packages: a writer, and a reader that never extracts.

A package is a ZIP file with stored (uncompressed) members: archives below `archive/`, one gzip member per record, and
indexes below `indexes/`, plain or gzipped, with a CDXJ line per record (key, time, JSON with filename, offset and
length). The reader finds the end-of-central-directory record (and its ZIP64 form), reads the central directory, takes
each member's data offset from its local header, reads all indexes, and fetches spans of records by range reads inside
the stored archives. Records other than responses and revisits are passed over; a record of another writer, whose name
is no page's, has a null page_id. A package without an index, or with compressed archives, raises ValueError.

Packages live below a folder that every executor sees; a task writes a file of its own name and only the names that
successful tasks return are read. A null html is an empty payload; payloads of at least `least` bytes that repeat are
written once, by the smallest page_id, and revisited by the others (rows that share that smallest id are all
responses). A null url becomes the record's own URN; a null page_id gives an URN without a number and reads back as
null. An empty table gives an empty result; other columns of pages are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm.text import materialize, scratch

ARCHIVE, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Bytes of archive in a package; bytes and records of one range read.
PACKAGE_BYTES, SPAN_BYTES, SPAN_RECORDS = 256 << 20, 4 << 20, 512
WHEN = "2024-01-01T00:00:00Z"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def urn(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def surt(url: str | None) -> str:
    """The key of a URL in an index: its host from the top level down, then path and query."""
    x = urlsplit(url or "")
    host = re.sub(r"^www\d*\.", "", (x.netloc.rpartition("@")[2].partition(":")[0]).lower())
    key = f"{','.join(reversed(host.split('.')))}){x.path.lower() or '/'}{'?' + x.query.lower() if x.query else ''}" if host else (url or "-")
    return quote(key, safe=":/?#[]@!$&()*+,;=%~")


def entries(raw: bytes) -> Iterator[dict]:
    """The JSON part of each line of an index, plain or gzipped."""
    lines = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    for line in lines:
        at = line.find(b"{")
        if at >= 0 and not line.startswith(b"!"):
            yield json.loads(line[at:])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record, compressed as a gzip member of its own."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <{urn(page_id)}>",
        f"WARC-Date: {WHEN}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else urn(page_id)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if first is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{urn(first)}>"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """(data offset, stored size, method) of each member of a ZIP file, from its central directory."""
    tail_at = max(0, size - 65_557)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end-of-central-directory record")
    count, length, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
    at += tail_at
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, offset) or (at >= 20 and f.read_at(4, at - 20) == b"PK\x06\x07"):
        sign, _, end64, _ = struct.unpack("<4sIQI", f.read_at(20, at - 20))
        if sign != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = f.read_at(56, end64)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end-of-central-directory record")
        count, length, offset = struct.unpack("<QQQ", end[32:56])
    out, central, p = {}, f.read_at(length, offset), 0
    for _ in range(count):
        sign, flags, method, packed, whole, n, m, k, local = struct.unpack("<4s4xHH8xIIHHH8xI", central[p : p + 46])
        if sign != b"PK\x01\x02":
            raise ValueError("not a central directory entry")
        name, extra = central[p + 46 : p + 46 + n], central[p + 46 + n : p + 46 + n + m]
        while len(extra) >= 4:  # 64-bit values stand in the order of the fields that overflow
            tag, size_ = struct.unpack("<HH", extra[:4])
            if tag == 1:
                wide = list(struct.unpack(f"<{size_ // 8}Q", extra[4 : 4 + size_ // 8 * 8]))
                whole = wide.pop(0) if whole == 0xFFFFFFFF else whole
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + size_ :]
        head = f.read_at(30, local)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("not a local file header")
        n2, m2 = struct.unpack("<HH", head[26:30])
        out[name.decode("utf-8" if flags & 0x800 else "cp437")] = (local + 30 + n2 + m2, packed, method)
        p += 46 + n + m + k
    return out


def write_package(out, rows: Iterator[tuple[int | None, str | None, bytes, str, int | None]], most: int = PACKAGE_BYTES, zip64: bool = True) -> int:
    """Write records from rows until `most` bytes of archive are reached; how many."""
    lines, at = [], 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=zip64) as archive:
            for page_id, url, payload, digest, first in rows:
                raw = record(page_id, url, payload, digest, first)
                archive.write(raw)
                about = {"url": url or urn(page_id), "digest": f"sha256:{digest}", "filename": ARCHIVE.rpartition("/")[2], "offset": at, "length": len(raw)}
                lines.append(f"{surt(url)} {re.sub('[^0-9]', '', WHEN)} {json.dumps(about)}")
                at += len(raw)
                if at >= most:
                    break
        with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=zip64) as index:
            index.write("".join(f"{x}\n" for x in sorted(lines)).encode())
        z.writestr(zipfile.ZipInfo(PACKAGE), json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}))
    return len(lines)


def write(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html) into packages below folder; (path, records) of each."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    slim = rows.where(F.octet_length("payload") >= least).select("page_id", "digest")
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # only repeats carry a reference: the digest's join has no payloads in it, and page_id spreads evenly
    again = slim.join(firsts, "digest").where("page_id > first").select("page_id", "digest", "first").distinct()
    rows = rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in batches:
                for x in zip(*(c.to_pylist() for c in b.columns)):
                    yield x

        stream, done = each(), object()
        nxt = next(stream, done)
        while nxt is not done:
            place, path = filesystem(f"{folder}/{uuid.uuid4().hex}.zip")
            place.create_dir(path.rpartition("/")[0], recursive=True)

            def from_next(nxt=nxt):
                yield nxt
                yield from stream

            with place.open_output_stream(path) as out:
                n = write_package(out, from_next())
            yield pa.record_batch({"path": pa.array([f"{folder}/{path.rpartition('/')[2]}"]), "records": pa.array([n], pa.int64())})
            nxt = next(stream, done)

    return rows.mapInArrow(run, "path string, records long")


def _digest_of(payload: bytes, named: str | None) -> tuple[str, bool]:
    """The bare digest of a payload in the kind that is named (SHA-256 where none is), and whether it is the named one."""
    kind, _, value = (named or "").partition(":")
    if kind == "sha1":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return found, found == value.upper() or hashlib.sha1(payload).hexdigest() == value.lower()
    found = hashlib.sha256(payload).hexdigest()
    return found, kind != "sha256" or found == value.lower()


def read(packages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every response and revisit of packages(path)."""

    def locate(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                place, path = filesystem(uri)
                spans = []
                with place.open_input_file(path) as f:
                    found = members(f, f.size())
                    indexes = [m for n, m in sorted(found.items()) if n.startswith("indexes/") and m[1]]
                    archives = {n.removeprefix("archive/"): m for n, m in found.items() if n.startswith("archive/") and not n.endswith("/")}
                    if archives and not any(n.startswith("indexes/") for n in found):
                        raise ValueError(f"{uri} has no index")
                    if any(m[2] for m in [*indexes, *archives.values()]):
                        raise ValueError("members are not stored")
                    own = sorted((x["filename"].removeprefix("archive/"), int(x["offset"]), int(x["length"])) for at, size, _ in indexes for x in entries(f.read_at(size, at)))
                    before = None
                    for name, at, size in dict.fromkeys(own):  # two indexes may name one record
                        base = archives[name][0]
                        if before != (name, at) or len(spans[-1][1]) >= SPAN_RECORDS or sum(spans[-1][1]) + size > SPAN_BYTES:
                            spans.append((base + at, []))
                        spans[-1][1].append(size)
                        before = (name, at + size)
                yield pa.record_batch({"path": pa.array([uri] * len(spans), pa.string()), "at": pa.array([s[0] for s in spans], pa.int64()), "lengths": pa.array([s[1] for s in spans], pa.list_(pa.int64()))})

    def fetch(batches):
        def number(x):
            hit = re.fullmatch(r"<urn:page:(\d+)>", x or "")
            return int(hit[1]) if hit else None

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        for b in batches:
            for uri, at, lengths in zip(*(c.to_pylist() for c in b.columns)):
                place, path = filesystem(uri)
                with place.open_input_file(path) as f:
                    raw = f.read_at(sum(lengths), at)
                out, p = [], 0
                for n in lengths:
                    fields, block = parse(zlib.decompress(raw[p : p + n], 31))
                    p += n
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                    named = fields.get("warc-payload-digest")
                    digest, same = _digest_of(payload, named) if fields["warc-type"] == "response" else ((named or "").rpartition(":")[2], True)
                    if fields["warc-type"] == "response" and (len(payload) != size or not same):
                        raise ValueError(f"damaged record {fields['warc-record-id']}")
                    out.append((number(fields["warc-record-id"]), size, digest, fields["warc-type"], number(fields.get("warc-refers-to")), fields["warc-target-uri"]))
                columns = zip(*out) if out else [()] * len(kinds)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = packages.select("path").repartition(parts).mapInArrow(locate, "path string, at long, lengths array<long>")
    return spans.repartition(parts).mapInArrow(fetch, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 100) -> DataFrame:
    """Write pages into packages in the shared folder, once, and read them back."""
    folder = scratch(spark, "warc")
    return read(materialize(write(pages, folder, least), "packages"))
