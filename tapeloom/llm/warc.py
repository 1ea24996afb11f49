"""WARC archives as seekable Zstandard bundles."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, written

# Fixed values of the public seekable format: a skippable frame holds the table
# of (compressed size, decompressed size) pairs and ends in a 9-byte footer.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class BundleWriter:
    """Groups records into independent frames and ends with the seek table."""

    def __init__(self, sink: BinaryIO, frame_bytes: int, level: int = 3):
        self.sink, self.frame_bytes, self.codec = sink, frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.size, self.at, self.table = [], 0, 0, []

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Append; returns (frame, the frame's offset in the bundle, the record's offset in the frame)."""
        if self.held and self.size + len(record) > self.frame_bytes:
            self.flush()
        place = (len(self.table), self.at, self.size)
        self.held.append(record)
        self.size += len(record)
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.codec.compress(b"".join(self.held))
            self.sink.write(frame)
            self.table.append((len(frame), self.size))
            self.at += len(frame)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + FOOTER.pack(len(self.table), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


def seek_table(uri: str) -> list[tuple[int, int, int]]:
    """``(offset, compressed size, decompressed size)`` of each frame, from the bundle's end."""
    where, path = opened(uri)
    with where.open_input_file(path) as f:
        size = f.size()
        count, _, magic = FOOTER.unpack(f.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        body = f.read_at(8 * count, size - FOOTER.size - 8 * count)
    out, at = [], 0
    for small, large in struct.iter_unpack("<II", body):
        out.append((at, small, large))
        at += small
    return out


def read_frame(uri: str, offset: int, size: int) -> bytes:
    where, path = opened(uri)
    with where.open_input_file(path) as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(size, offset))


def record(kind: str, id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, so the payload's size, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{id}>" if id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The headers and block of the record at ``at``, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    start = end + 4
    stop = start + int(head["content-length"])
    return head, data[start:stop], stop + 4


def _page(name: str | None) -> int | None:
    return int(name[len("<urn:page:") : -1]) if name and name.startswith("<urn:page:") else None


def record_row(head: dict[str, str], block: bytes) -> tuple:
    """``(id, payload size, digest, kind, refers_to)`` as an archive's reader sees them."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    if head["warc-type"] != "revisit" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {head['warc-record-id']}")
    return _page(head["warc-record-id"]), size, digest, head["warc-type"], _page(head.get("warc-refers-to"))


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """``(id, url, payload, digest, refers_to)``: which rows repeat an earlier payload.

    Of rows with equal payloads of ``least`` bytes or more, the smallest id (and
    rows that repeat it) is the response, which the others refer to; a null id is
    never referred to. Only ids and digests are grouped; payloads then meet their
    target by id, so that one payload with very many copies makes no hot key.
    """
    rows = pages.withColumn("digest", F.sha2("payload", 256))
    slim = rows.where(F.octet_length("payload") >= least).select("id", "digest")
    first = slim.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = slim.join(first, "digest").where("id is null or id != refers_to").where("refers_to is not null").distinct()
    again = again.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    return rows.join(again, rows["id"].eqNullSafe(again["__id"]) & (rows["digest"] == again["__digest"]), "left").drop("__id", "__digest")


def write_archive(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 27, least: int = 100) -> DataFrame:
    """Write a record for each row into bundles in ``folder``; returns the index.

    The index has ``id, bundle, frame, frame_offset, record_offset`` for each
    record, and is written before this returns. Each task writes files of its own
    under a new name, and the index names only those of tasks that ended well, so
    a task that is tried again leaves nothing but an unnamed file. A null page is
    an empty payload; a null id gets a random record id and reads back as null.
    """
    picked = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = with_revisits(picked, least).select("id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened(folder)
        where.create_dir(base, recursive=True)
        bundle = out = name = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = []
                for i, u, payload, digest, to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if bundle is None:
                        name = f"bundle-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                        out = where.open_output_stream(f"{base}/{name}", compression=None)
                        bundle = BundleWriter(out, frame_bytes)
                    got.append((i, name, *bundle.add(record("response" if to is None else "revisit", i, u, payload, digest, to))))
                    if bundle.at >= bundle_bytes:
                        bundle.close(), out.close()
                        bundle = None
                cols = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["id", "bundle", "frame", "frame_offset", "record_offset"])
        if bundle is not None:
            bundle.close(), out.close()

    return written(rows.mapInArrow(run, "id long, bundle string, frame int, frame_offset long, record_offset long"), "index")


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles that ``index`` names, read through their seek tables.

    Returns ``id, payload_bytes, payload_digest, record_type, refers_to``. Frames
    are independent, so they are dealt out one by one; payloads are checked
    against their digests.
    """

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                got = seek_table(f"{folder}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(got)), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], names=["bundle", "at", "size"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for name, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, k, got = read_frame(f"{folder}/{name}", at, size), 0, []
                while k < len(data):
                    head, block, k = parse(data, k)
                    got.append(record_row(head, block))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    frames = index.select("bundle").distinct().mapInArrow(tables, "bundle string, at long, size long")
    return frames.repartition("bundle", "at").mapInArrow(records, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def lookup(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The payload (null for a revisit) of each record that ``wanted`` (a column ``id``) names.

    Records are dealt by bundle and read in the order of their frames, so that a
    seek table and a frame are read once for all records wanted of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, data, bundle, last = [], b"", None, None
        for batch in batches:
            for i, name, frame, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != bundle:
                    table, bundle, last = seek_table(f"{folder}/{name}"), name, None
                if frame != last:
                    offset, size, _ = table[frame]
                    data, last = read_frame(f"{folder}/{name}", offset, size), frame
                head, block, _ = parse(data, at)
                payload = None if head["warc-type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([head["warc-type"]]), pa.array([payload], pa.binary())], names=["id", "record_type", "payload"])

    found = index.join(wanted.select("id").distinct(), "id").select("id", "bundle", "frame", "record_offset")
    return found.repartition("bundle").sortWithinPartitions("bundle", "frame", "record_offset").mapInArrow(run, "id long, record_type string, payload binary")


def archived(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """Write all ``pages`` to an archive in the shared folder, and read it back."""
    folder = scratch_path(pages.sparkSession, "warc")
    index = write_archive(pages, folder, id, url, html, least=least)
    return read_archive(index, folder).withColumnRenamed("id", id)
