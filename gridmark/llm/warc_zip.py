"""WARC records in ZIP packages, written and read back by range.

Every task packs its records into archives of about ``ARCHIVE_BYTES``: a ZIP file whose members are stored without
compression, ``archive/data.warc.gz`` (one gzip member a record) and ``indexes/index.cdxj`` (a line with offset and
length a record).  The members are written with ZIP64 fields.  Archives go to the shared folder under names that no
other attempt uses; the manifest of archives is settled, so a lost executor doesn't repeat a write.

The reader extracts nothing.  It reads an archive's tail for the end record (and the ZIP64 one), the central directory
it points to, the local headers of the stored members, the index, then each record by its byte range.

Of records with equal payloads, the one with the largest id is the response, the others are revisits that name it.
Null html has an empty payload.  Rows with the same id and payload are alike; null ids come after all others, and
stay the response only where a payload has no other id.  Payload groups are found by hash aggregation and a join that
AQE can split.
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
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import opened
from .store import settled, shared_dir, sifted, small_batches

ARCHIVE_BYTES = 16 << 20
#: Bytes of neighbouring records that are read at once.
RUN_BYTES = 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def _base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A gzip member with one WARC record; a revisit carries no payload, only the digest and length of it."""
    body = b"" if revisit else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode()}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{_base32(payload)}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 5, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length differs")
    return headers, rest[:size]


def pack(records: list[tuple[str, bytes]]) -> bytes:
    """An archive of (index key, gzip member) records."""
    data, lines, at = io.BytesIO(), [], 0
    for key, raw in records:
        lines.append(json.dumps({"key": key, "offset": at, "length": len(raw)}))
        data.write(raw)
        at += len(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in ((DATA, data.getbuffer()), (INDEX, "\n".join(lines).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                member.write(body)
    return out.getvalue()


class Archive:
    """Stored members of a ZIP file behind an object with ``size()`` and ``read_at(length, offset)``."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail_at = max(0, size - (1 << 16) - 22 - 20 - 56)
        tail = file.read_at(size - tail_at, tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + 22 > len(tail) or tail_at + end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != size):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no ZIP end record")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
            (at,) = struct.unpack_from("<Q", tail, end - 12)
            wide = file.read_at(56, at)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", wide, 32)
        self.members = self._directory(file.read_at(length, start), count)

    @staticmethod
    def _directory(raw: bytes, count: int) -> dict[str, tuple[int, int]]:
        """Name to local header's offset and size, of stored members."""
        out, at = {}, 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a directory entry is missing")
            method, packed, full, name, extra, note, offset = *struct.unpack_from("<H", raw, at + 10), *struct.unpack_from("<IIHHH", raw, at + 20), *struct.unpack_from("<I", raw, at + 42)
            more, end = at + 46 + name, at + 46 + name + extra
            while more + 4 <= end:
                tag, size = struct.unpack_from("<HH", raw, more)
                if tag == 1:  # 64-bit values, in this order, of the fields that are full
                    wide = iter(struct.unpack_from(f"<{size // 8}Q", raw, more + 4))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                more += 4 + size
            if method == 0:
                out[raw[at + 46 : at + 46 + name].decode()] = (offset, packed)
            at = end + note
        return out

    def start(self, name: str) -> int:
        """Where a member's bytes begin."""
        offset, _ = self.members[name]
        head = self.file.read_at(30, offset)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no local header")
        return offset + 30 + sum(struct.unpack_from("<HH", head, 26))

    def records(self) -> Iterator[bytes]:
        """The records of the index by their ranges; ranges side by side are read together, up to RUN_BYTES."""
        start, index = self.start(DATA), self.start(INDEX)
        run: list[tuple[int, int]] = []

        def read() -> Iterator[bytes]:
            first = run[0][0]
            raw = self.file.read_at(sum(run[-1]) - first, start + first)
            for offset, length in run:
                yield raw[offset - first : offset - first + length]
            run.clear()

        for line in self.file.read_at(self.members[INDEX][1], index).splitlines():
            entry = json.loads(line)
            if run and (entry["offset"] != sum(run[-1]) or sum(run[-1]) - run[0][0] >= RUN_BYTES):
                yield from read()
            run.append((entry["offset"], entry["length"]))
        if run:
            yield from read()


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, path = opened(folder)
    held: list[tuple[str, bytes]] = []

    def flush() -> pa.RecordBatch:
        name = f"{path}/{uuid.uuid4().hex}.zip"
        with store.open_output_stream(name) as out:
            out.write(pack(held))
        done = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["archive", "records"])
        held.clear()
        return done

    size = 0
    for batch in batches:
        for key, url, html, refers, revisit in zip(*(batch.column(k) for k in range(5)), strict=True):
            raw = record(key.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py(), revisit.as_py())
            held.append((str(key.as_py()), raw))
            size += len(raw)
            if size >= ARCHIVE_BYTES:
                yield flush()
                size = 0
    if held:
        yield flush()


def write(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives of the rows of ``df``; the settled manifest (archive, records).

    Keys are whole numbers (cast to long).  Pages whose payload no other has are written where they are read; only those
    that may have a copy are shuffled, to learn of the newest one, by a join that Spark can split.
    """
    spark = df.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    newest = settled(rows.select("key", digest.alias("digest")).groupBy("digest").agg(F.max("key").alias("newest"), F.count("*").alias("n")).where("n > 1").drop("n"))
    own, names = rows.withColumn("digest", digest), newest.select("digest")
    alone = sifted(own, "digest", names, inside=False).withColumn("newest", F.lit(None).cast("long"))
    marked = sifted(own, "digest", names).join(newest, "digest", "left").unionByName(alone)
    revisit = F.col("newest").isNotNull() & ~F.col("key").eqNullSafe(F.col("newest"))
    return settled(marked.select("key", "url", "html", F.col("newest").alias("refers"), revisit.alias("revisit")).mapInArrow(partial(_write, folder), "archive string, records bigint"))


class _File:
    def __init__(self, file):
        self.file = file

    def size(self) -> int:
        return self.file.size()

    def read_at(self, length: int, offset: int) -> bytes:
        return self.file.read_at(length, offset)


def _records(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, _ = opened(folder)
    ident = lambda x: int(x) if (x := x[len("<urn:page:") : -1]) else None
    for batch in batches:
        for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            with store.open_input_file(name) as file:
                for raw in Archive(_File(file)).records():
                    h, body = parse(raw)
                    kind, digest, size = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                    if kind == "response" and (len(body) != size or _base32(body) != digest):
                        raise ValueError(f"{name}: a payload differs from its digest")
                    rows.append((ident(h["warc-record-id"]), size, digest, kind, ident(h["warc-refers-to"]) if kind == "revisit" else None))
            if len(rows) != count:
                raise ValueError(f"{name}: {len(rows)} records of {count}")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_back(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives.  A response's
    digest and length are checked against its payload."""
    folder = shared_dir(manifest.sparkSession)
    return manifest.mapInArrow(partial(_records, folder), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
