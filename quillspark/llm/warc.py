"""WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each of a few records, and a skippable frame at
its end with the sizes of all frames (the seekable format). Opening one reads the footer only; a record
is found by its frame and its offset inside the decompressed frame, which the manifest holds by id.
A task writes under a name of its own attempt and renames at the end, so a lost executor leaves at most
an unnamed file; rows of the manifest exist only for bundles that were finished.

Payloads of at least `REVISIT_BYTES` that several records share are stored once, with the largest id;
the others become revisit records that name it.

Cases: a null payload is empty; a null id sorts below every other; an id that repeats with the same
payload gives one response per row (each its own record); an empty table gives no bundle and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import new_path, size_of, stage

FRAME_BYTES, BUNDLE_BYTES, REVISIT_BYTES, LEVEL = 1 << 20, 256 << 20, 1000, 6
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
MANIFEST = "page_id long, path string, frame int, at int, length int"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC 1.1 record."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}", "Content-Type: text/html"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at the start of data."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    return headers, data[end + 4 : end + 4 + int(headers["Content-Length"])]


class BundleWriter:
    """Appends records; frames end at FRAME_BYTES."""

    def __init__(self, out):
        self.out, self.frame, self.held, self.sizes, self.written = out, bytearray(), 0, [], 0
        self.codec = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset in it."""
        if self.frame and len(self.frame) + len(data) > FRAME_BYTES:
            self._end_frame()
        at = len(self.sizes), len(self.frame)
        self.frame += data
        return at

    def _end_frame(self) -> None:
        packed = self.codec.compress(bytes(self.frame))
        self.out.write(packed)
        self.sizes.append((len(packed), len(self.frame)))
        self.written += len(packed)
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self._end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to a bundle's records; the last frame stays decompressed."""

    def __init__(self, source, size: int):
        self.source, self.kept = source, (-1, b"")
        source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        source.seek(size - 9 - 8 * count)
        sizes = list(struct.iter_unpack("<II", source.read(8 * count)))
        self.frames, start = [], 0
        for packed, plain in sizes:
            self.frames.append((start, packed, plain))
            start += packed

    def read(self, frame: int, at: int, length: int) -> tuple[dict[str, str], bytes]:
        if self.kept[0] != frame:
            start, packed, plain = self.frames[frame]
            self.source.seek(start)
            self.kept = frame, zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        return parse(self.kept[1][at : at + length])


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds digest and the id of the response that a shared payload refers to (null for the response itself)."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    small = rows.where(F.octet_length("html") >= REVISIT_BYTES).select("digest", "page_id")
    shared = small.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "response")
    shared, path = stage(shared, "shared-payloads")
    if size_of(spark, path) <= 8 << 20:  # known, so no row needs to move; else the join shuffles, and adaptive execution splits a hot digest
        shared = F.broadcast(shared)
    return rows.join(shared, "digest", "left").withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("response")), None).otherwise(F.col("response"))).drop("response")


def write(pages: DataFrame, root: str | None = None) -> tuple[DataFrame, str]:
    """Writes bundles of all pages below root; the manifest, itself written there, and root."""
    root = root or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        writer = path = None
        rows: list[tuple] = []

        def end() -> pa.RecordBatch:
            writer.close()
            store.move(f"{path}.part", path)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], ["page_id", "path", "frame", "at", "length"])

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if writer is None:
                    store.create_dir(f"{base}/bundles")
                    path, rows = f"{base}/bundles/{uuid.uuid4().hex}.warc.zst", []
                    writer = BundleWriter(store.open_output_stream(f"{path}.part"))
                data = record(page_id, url, (html or "").encode(), digest, refers, refers is not None)
                rows.append((page_id, path, *writer.add(data), len(data)))
                if writer.written >= BUNDLE_BYTES:
                    yield end()
                    writer = None
        if writer is not None:
            yield end()

    named = with_revisits(pages).select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, MANIFEST)
    named.write.parquet(f"{root}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{root}/manifest"), root


def read(manifest: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """A row per record of the manifest: id, headers and payload's digest as stored, verified where it is stored in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(root)[0] if "://" in root or root.startswith("file:") else fs.LocalFileSystem()
        path = reader = None
        for batch in batches:
            out: list[tuple] = []
            for page_id, where, frame, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                if where != path:
                    path, reader = where, BundleReader(store.open_input_file(where), store.get_file_info(where).size)
                headers, block = reader.read(frame, at, length)
                digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                    raise ValueError(f"record {page_id} in {where} is damaged")
                refers = headers.get("WARC-Refers-To")
                out.append((page_id, headers.get("WARC-Target-URI"), block if payloads and kind == "response" else None, int(headers["Payload-Length"]), digest, kind, int(refers[len("<urn:page:") : -1]) if refers else None))
            if out:
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads every record back; digests of what was read."""
    return read(*write(pages), payloads=False).drop("url", "payload")
