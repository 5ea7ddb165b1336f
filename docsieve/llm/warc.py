"""WARC archives in seekable Zstandard bundles.

A bundle is one file: independent frames that each hold a group of whole WARC records, a skippable frame with the record
index (record id, frame, offset in the frame's content, length), and the seek table of the seekable format as the
footer. Any Zstandard reader decodes a bundle from its start; with the footer one frame is found and decoded alone.

Spark's own text writer commits the files (one row is one file), so any store that Spark writes to will do, and a lost or
repeated task leaves no half-written bundle. Its line separator supplies the last four bytes, the magic number that
ends a seek table. ``binaryFile`` reads bundles back; their size is bounded by ``bundle_bytes`` plus one record.

Equal payloads are stored once. A null payload is an empty one. Of equal payloads, rows that hold the largest page_id
are responses (each of them, if that id is repeated) and the others revisit it; a null page_id is smaller than any
other, and where all ids are null all rows are responses. Null ids and repeated ids share a record id; records are told
apart by their place. A very long payload is a frame of its own. An empty table gives no bundle. Other columns are not
read.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path
from .components import spread_join

SEEK_MAGIC = 0x8F92EAB1
SKIP_SEEK, SKIP_INDEX = 0x184D2A5E, 0x184D2A51
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER = re.compile(rb"^([A-Za-z-]+): ?(.*?)\r?$", re.M)
RECORD_SCHEMA = "record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
INDEX_SCHEMA = "record_id string, path string, frame int, frame_start long, frame_bytes long, offset long, length long"


def _urn(page_id) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page(urn: bytes):
    tail = urn[len(b"<urn:page:") : -1]
    return None if tail == b"none" else int(tail)


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; a revisit keeps the head of the response, which has the payload's length, and leaves the payload out."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {uri}"] if url is not None else []
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if refers_to is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class Bundle:
    """Collects records into frames and frames into the bytes of one file."""

    def __init__(self, frame_bytes: int, level: int):
        self.limit, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[bytes] = []
        self.seek: list[tuple[int, int]] = []
        self.index: list[bytes] = []
        self.open: list[bytes] = []
        self.held = self.size = 0

    def add(self, name: str, data: bytes) -> None:
        self.index.append(f"{name}\t{len(self.seek)}\t{self.held}\t{len(data)}".encode())
        self.open.append(data)
        self.held += len(data)
        if self.held >= self.limit:
            self.flush()

    def flush(self) -> None:
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.frames.append(frame)
            self.seek.append((len(frame), self.held))
            self.size += len(frame)
            self.open, self.held = [], 0

    def body(self) -> bytes:
        """The file but for its last four bytes."""
        self.flush()
        index = self.zstd.compress(b"\n".join(self.index))
        skip = struct.pack("<II", SKIP_INDEX, len(index)) + index
        # the index frame is an entry of the seek table too: all bytes before the table are accounted for
        entries = [*self.seek, (len(skip), 0)]
        table = b"".join(struct.pack("<II", *x) for x in entries) + struct.pack("<IB", len(entries), 0)
        return b"".join(self.frames) + skip + struct.pack("<II", SKIP_SEEK, len(table) + 4) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, content size) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    for k in range(n):
        begin = len(data) - 9 - width * (n - k)
        size, content = struct.unpack("<II", data[begin : begin + 8])
        out.append((at, size, content))
        at += size
    return out


def index_of(data: bytes) -> list[tuple[str, int, int, int]]:
    """(record id, frame, offset in the frame's content, length) of each record."""
    at, size, _ = seek_table(data)[-1]
    held = zstandard.ZstdDecompressor().decompress(data[at + 8 : at + size])
    return [(a, int(b), int(c), int(d)) for a, b, c, d in (x.split("\t") for x in held.decode().split("\n") if x)]


def parse(data: bytes) -> Iterator[tuple]:
    """The page records of a frame's content."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = {k.lower(): v for k, v in HEADER.findall(data[at:end])}
        size = int(head[b"content-length"])
        block = data[end : end + size]
        at = end + size + 4
        kind = head[b"warc-type"].decode()
        if kind == "warcinfo":
            continue
        cut = block.index(b"\r\n\r\n") + 4
        length = int(dict((k.lower(), v) for k, v in HEADER.findall(block[:cut]))[b"content-length"])
        refers = head.get(b"warc-refers-to")
        url = head.get(b"warc-target-uri")
        yield (
            head[b"warc-record-id"].decode(), _page(head[b"warc-record-id"]), url if url is None else url.decode(), kind, refers if refers is None else _page(refers),
            head[b"warc-payload-digest"].decode().removeprefix("sha1:"), length, block[cut:] if kind == "response" else None,
        )


def planned(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, sha1, refers_to: which payloads are stored, and by whom."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    # one row for each repeated payload: hot payloads are counted before the shuffle
    kept = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("kept_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND kept_id IS NOT NULL").select("sha1", "kept_id")
    # a payload that stands on a third of all pages is one key: its rows can be split
    return spread_join(rows, kept, ["sha1"], "left").select("page_id", "url", "payload", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("kept_id")), F.col("kept_id")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 8 << 20, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each page into bundles under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened() -> Bundle:
            bundle = Bundle(frame_bytes, level)
            info = b"software: docsieve\r\nformat: WARC File Format 1.1\r\n"
            bundle.add("<urn:info>", f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
            return bundle

        bundle = None
        for batch in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(batch.column(k) for k in range(5))):
                bundle = bundle or opened()
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                bundle.add(_urn(page_id.as_py()), record(page_id.as_py(), url.as_py(), payload.as_py(), digest, refers_to.as_py(), date))
                if bundle.size >= bundle_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([bundle.body()], pa.binary())], ["value"])
                    bundle = None
        if bundle:
            yield pa.RecordBatch.from_arrays([pa.array([bundle.body()], pa.binary())], ["value"])

    rows = planned(pages, min_bytes).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    end = struct.pack("<I", SEEK_MAGIC).decode("latin-1")
    rows.write.options(lineSep=end, encoding="ISO-8859-1", maxRecordsPerFile=1).mode("append").text(path)


def bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All page records, found by the record index: each frame is decoded on its own and cut at the offsets the index gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for cell in batch.column(0):
                data = cell.as_py()
                frames, held = seek_table(data), {}
                for name, frame, at, size in index_of(data):
                    if name != "<urn:info>":
                        held.setdefault(frame, []).append((at, size))
                for frame, places in held.items():
                    begin, packed, _ = frames[frame]
                    content = unzip.decompress(data[begin : begin + packed])
                    yield _batch([row for at, size in places for row in parse(content[at : at + size])])

    return bundles(spark, path).select("content").mapInArrow(run, RECORD_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["record_id", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """Where each record lies: file, frame (its start and size in the file), offset and length in the frame's content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, cell in zip(batch.column(0), batch.column(1)):
                data = cell.as_py()
                table = seek_table(data)
                rows = [(name, file.as_py(), frame, table[frame][0], table[frame][1], at, size) for name, frame, at, size in index_of(data) if name != "<urn:info>"]
                if rows:
                    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [x.split()[0] for x in INDEX_SCHEMA.split(", ")])

    return bundles(spark, path).select("path", "content").mapInArrow(run, INDEX_SCHEMA)


def fetch(spark: SparkSession, path: str, wanted: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The records of ``wanted`` (record_id); only frames that hold one are decoded."""
    places = (index if index is not None else record_index(spark, path)).join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    frames = places.groupBy("path", "frame_start", "frame_bytes").agg(F.collect_list(F.struct("offset", "length")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for data, at in zip(batch.column(0), batch.column(1)):
                content = unzip.decompress(data.as_py())
                rows = [row for x in at.as_py() for row in parse(content[x["offset"] : x["offset"] + x["length"]])]
                yield _batch(rows)

    cut = bundles(spark, path).join(frames, "path").select(F.substring("content", F.col("frame_start").cast("int") + 1, F.col("frame_bytes").cast("int")).alias("frame"), "at")
    return cut.mapInArrow(run, RECORD_SCHEMA)


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the archives (into the shared folder if no path is given) and read all records back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    return read_archives(spark, path)
