"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about `frame_bytes`, a bundle ends with a seek table in a skippable frame
(the public seekable format), and an index table maps each record's id to its bundle, frame and offset inside the
frame. One record is read by fetching one frame; a whole bundle by its seek table. Tasks write their bundles straight to
the shared folder under names of their own attempt; the index lists those of the attempts that succeeded, so lost
executors leave at most unlisted files behind.

Of records with equal payloads of at least `min_bytes` bytes the one with the largest id is stored as a response, the
others as revisits of it; equality is that of SHA-1 and length. Null payloads are empty; a null id is smaller than all
others and its record has an empty id; a null URL leaves the target header out. Rows that repeat the response's id are
responses as well. Extra columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilelab.llm.common import shared_dir, staged, table
from profilelab.llm.near_dups import bounded_broadcast

FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
# Fixed values of the public formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id long, bundle string, frame int, frame_start long, frame_size long, offset long, length long"
_LEAST = -(1 << 63)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _clean(value: str) -> str:
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_bytes(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if record_id is None else record_id
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Frames of records, then the seek table."""

    def __init__(self, uri: str, frame_bytes: int):
        system, path = _open(uri)
        self.uri, self.out, self.frame_bytes = uri, system.open_output_stream(path, compression=None), frame_bytes
        self.zip = zstandard.ZstdCompressor(level=3)
        self.frame, self.size, self.members, self.table, self.at = [], 0, [], [], 0
        self.index: list[tuple] = []
        self.total = 0

    def add(self, record_id: int | None, data: bytes) -> None:
        self.members.append((record_id, self.size, len(data)))
        self.frame.append(data)
        self.size += len(data)
        self.total += len(data)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.frame:
            return
        packed = self.zip.compress(b"".join(self.frame))
        self.out.write(packed)
        self.index += [(i, self.uri, len(self.table), self.at, len(packed), o, n) for i, o, n in self.members]
        self.table.append((len(packed), self.size))
        self.at += len(packed)
        self.frame, self.size, self.members = [], 0, []

    def close(self) -> list[tuple]:
        self._flush()
        body = b"".join(struct.pack("<II", *t) for t in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        return self.index


def seek_table(f: pa.NativeFile) -> list[tuple[int, int]]:
    """(compressed start, compressed size) of the frames, from the footer."""
    n, _, magic = struct.unpack("<IBI", f.read_at(9, f.size() - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    entries = f.read_at(8 * n, f.size() - 9 - 8 * n)
    out, at = [], 0
    for packed, _ in struct.iter_unpack("<II", entries):
        out.append((at, packed))
        at += packed
    return out


def unpack_frame(f: pa.NativeFile, start: int, size: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(f.read_at(size, start))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records in a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("ascii").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _id(value: str | None) -> int | None:
    body = value[len("<urn:page:") : -1] if value else ""
    return int(body) if body else None


def described(head: dict[str, str], block: bytes) -> tuple:
    """(id, url, payload bytes, digest, type, refers to, payload); a response's digest is that of the bytes read."""
    http, payload = block.split(b"\r\n\r\n", 1)
    length = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if kind == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != length:
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
        return _id(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), length, digest, kind, None, payload
    return _id(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), length, digest, kind, _id(head["WARC-Refers-To"]), None


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
                   frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the bundles below `folder`; returns the index, itself a table of the shared folder."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("sha1"), F.octet_length(body).alias("n"))
    # Digests with several records; copies are counted before the shuffle.
    shared = staged(rows.where(F.col("n") >= min_bytes).groupBy("sha1", "n").agg(F.count(F.lit(1)).alias("c"), F.max("id").alias("first")).where("c > 1").select("sha1", "n", "first"))
    marked = rows.join(bounded_broadcast(shared, shared.count()), ["sha1", "n"], "left")
    plain = marked.select("id", "url", "payload", "sha1", "first", (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"))

    def batches(it):
        writer = None

        def finish(w):
            cols = list(zip(*w.close()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4))],
                                              ["record_id", "bundle", "frame", "frame_start", "frame_size", "offset", "length"])

        for batch in it:
            for i in range(batch.num_rows):
                rid, link, payload, sha1, first, revisit = (c[i].as_py() for c in batch.columns)
                if writer is None:
                    writer = BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                writer.add(rid, record_bytes(rid, link, payload, digest, first, date, revisit))
                if writer.total >= bundle_bytes:
                    yield finish(writer)
                    writer = None
        if writer is not None:
            yield finish(writer)

    return staged(plain.mapInArrow(batches, INDEX))


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    cols = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)][: 7 if payloads else 6], names[: 7 if payloads else 6])


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that the index lists, bundle by bundle and frame by frame through the seek tables."""
    def batches(it):
        for batch in it:
            for uri in batch.column(0).to_pylist():
                system, path = _open(uri)
                with system.open_input_file(path) as f:
                    for start, size in seek_table(f):
                        yield _batch([described(h, b) for h, b in parse_records(unpack_frame(f, start, size))], payloads)

    bundles = staged(index.select("bundle").distinct())
    spread = bundles.repartition(max(1, min(bundles.count(), 10_000)), "bundle")
    return spread.mapInArrow(batches, RECORDS if payloads else RECORDS.rsplit(",", 1)[0])


def fetch(index: DataFrame, ids: DataFrame, record_id: str = "record_id") -> DataFrame:
    """The records of some ids, by reading only the frames that hold them."""
    def batches(it):
        for batch in it:
            for r in batch.to_pylist():
                system, path = _open(r["bundle"])
                with system.open_input_file(path) as f:
                    data = unpack_frame(f, r["frame_start"], r["frame_size"])
                yield _batch([described(h, b) for h, b in parse_records(data[r["offset"] : r["offset"] + r["length"]])], True)

    wanted = ids.select(F.col(record_id).cast("long").alias("record_id")).distinct()
    return index.join(wanted, "record_id", "left_semi").mapInArrow(batches, RECORDS)


def op6_warc_bundles(spark: SparkSession, sf: str) -> DataFrame:
    index = write_archives(table(spark, sf, "pages").select("page_id", "url", "html"))
    return read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '')"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM m
"""
