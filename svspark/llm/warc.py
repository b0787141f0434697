"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames with a few records each, closed by a seek table
in a skippable frame (the public seekable format), so any frame can be found and read alone. An
index maps each record to its bundle, its frame and its offset in the frame.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, with_group

#: Fixed values of the seekable format: skippable frame of the seek table, and what ends the file.
SEEK_FRAME, SEEK_END = 0x184D2A5E, 0x8F92EAB1

INDEX = "bundle string, page_id long, frame int, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes, date: str) -> bytes:
    """A WARC response record, or a revisit record (``refers_to``) that leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, where the next record starts) of the record of ``data`` at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record isn't closed")
    return headers, data[start:stop], stop + 4


class BundleWriter:
    """Writes records into one bundle; ``close`` adds the seek table and gives the file its name."""

    def __init__(self, folder: str, frame_bytes: int, level: int):
        self.fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.path = f"{base}/{self.name}"
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.coder, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames: list[tuple[int, int]] = []
        self.open, self.held, self.written = [], 0, 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, offset in it, length)"""
        place = len(self.frames), self.held, len(data)
        self.open.append(data)
        self.held += len(data)
        if self.held >= self.frame_bytes:
            self._frame()
        return place

    def _frame(self) -> None:
        if self.open:
            packed = self.coder.compress(b"".join(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), self.held))
            self.written += len(packed)
            self.open, self.held = [], 0

    def close(self) -> None:
        self._frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


class BundleReader:
    """Reads frames of a bundle by the seek table at its end."""

    def __init__(self, path: str):
        fs, name = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        self.file.seek(size - 9)
        n, flags, end = struct.unpack("<IBI", self.file.read(9))
        if end != SEEK_END or flags:
            raise ValueError("no seek table at the end")
        self.file.seek(size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, whole in struct.iter_unpack("<II", self.file.read(8 * n)):
            self.frames.append((at, packed, whole))
            at += packed
        self.coder = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        at, packed, whole = self.frames[number]
        self.file.seek(at)
        return self.coder.decompress(self.file.read(packed), max_output_size=whole)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]


def _number(urn: str | None) -> int | None:
    digits = re.fullmatch(r"<urn:page:(-?\d*)>", urn or "<urn:page:>")[1]
    return int(digits) if digits else None


def write_bundles(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 1000,
    frame_bytes: int = 256 << 10,
    bundle_bytes: int = 64 << 20,
    level: int = 6,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row of ``pages`` into bundles below ``folder``; returns the written index.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest id are
    responses and the others revisit it; smaller payloads are all responses, and so are payloads of
    rows whose ids are all null. Null html is an empty payload, a null url has no target header.
    Rows that repeat get a record each; extra columns aren't read; an empty table gives an empty
    index. Each task writes its own files under new names and moves them into place when they are
    whole, and the index names only files of tasks that ended well, so lost executors and repeated
    attempts leave no false records. The folder must be one that all executors reach.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("html"),
        F.sha1(F.encode(payload, "utf-8")).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
    )
    # one row a payload; a payload that a large share of all rows has is met without a shuffle
    keepers = cut(rows.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")), "warc-keepers")
    revisits = (F.col("size") >= least_bytes) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    decided = with_group(rows, keepers, ["digest"], size="copies").select(
        "page_id", "url", "digest", "size", F.when(revisits, F.col("keeper")).alias("refers_to"), "html"
    )
    # a revisit's payload isn't written: it is dropped here, behind the join that decides on it
    decided = decided.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = None, []

        def close() -> pa.RecordBatch:
            nonlocal bundle
            bundle.close()
            path, bundle = f"{folder}/{bundle.name}", None
            cols = list(zip(*rows, strict=True))
            rows.clear()
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([path] * len(cols[0])), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
                names=["bundle", "page_id", "frame", "offset", "length"],
            )

        for batch in batches:
            for page, url_, digest, size, refers_to, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = bundle or BundleWriter(folder, frame_bytes, level)
                body = (text or "").encode("utf-8", "surrogatepass")
                rows.append((page, *bundle.add(record(page, url_, digest, size, refers_to, body, date))))
                if bundle.written >= bundle_bytes:
                    yield close()
        if bundle:
            yield close()

    return cut(decided.mapInArrow(run, INDEX), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """The records of all bundles that ``index`` names, read frame by frame; payloads are checked
    against their digests. Returns page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader = BundleReader(path)
                for number in range(len(reader.frames)):
                    data, at, rows = reader.frame(number), 0, []
                    while at < len(data):
                        headers, block, at = parse(data, at)
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Type"] == "response" and (hashlib.sha1(body).hexdigest(), len(body)) != (digest, size):
                            raise ValueError(f"a payload in {path} doesn't match its digest")
                        rows.append((_number(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], _number(headers.get("WARC-Refers-To"))))
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                    )

    bundles = index.select("bundle").distinct()
    return bundles.repartition(max(1, min(4096, bundles.count()))).mapInArrow(run, RECORDS)


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, headers, block) of the records whose ids are in ``wanted(page_id)``: reads their frames only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = number = reader = data = None
        for batch in batches:
            for bundle, page, frame, offset in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if bundle != path:
                    path, number, reader = bundle, None, BundleReader(bundle)
                if frame != number:
                    number, data = frame, reader.frame(frame)
                headers, block, _ = parse(data, offset)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page], pa.int64()), pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())],
                    names=["page_id", "headers", "block"],
                )

    places = index.join(wanted.select("page_id").distinct(), "page_id").select("bundle", "page_id", "frame", "offset")
    return places.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(
        run, "page_id long, headers map<string,string>, block binary"
    )


def archive(pages: DataFrame, **settings) -> DataFrame:
    """Write ``pages`` into bundles in the shared folder and return the index."""
    return write_bundles(pages, shared_dir(pages.sparkSession, "warc"), **settings)
