"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole records, followed by a skippable
frame with the seek table (compressed and uncompressed size of each frame). The index maps a record to
its bundle, frame and offset inside the uncompressed frame, so one record is read by fetching the end
of the file and one frame.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.llm.shared import scratch, small_batches, stage

# fixed values of the seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
MIN_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id bigint, bundle string, frame int, offset bigint, length bigint"
RECORD = ("page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, "
          "payload binary")


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def make_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head alone."""
    target = re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:page"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(page_id)}",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    named = dict(line.split(": ", 1) for line in lines)
    first, size = end + 4, int(named["Content-Length"])
    block = data[first:first + size]
    head, payload = block.split(b"\r\n\r\n", 1)
    digest = named["WARC-Payload-Digest"].removeprefix("sha256:")
    response = named["WARC-Type"] == "response"
    if response and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {named['WARC-Record-ID']} does not have its digest")
    full = len(payload) if response else int(re.search(rb"Content-Length: (\d+)", head)[1])
    url = named["WARC-Target-URI"]
    return {"page_id": page_of(named["WARC-Record-ID"]), "url": None if url == "urn:page" else url,
            "record_type": named["WARC-Type"], "refers_to": page_of(named.get("WARC-Refers-To")),
            "payload_digest": digest, "payload_bytes": full, "payload": payload if response else None}, first + size + 4


class BundleWriter:
    """Streams records into one bundle; memory holds one frame."""

    def __init__(self, fs, path: str, frame_bytes: int):
        self.out, self.frame_bytes = fs.open_output_stream(path, compression=None), frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frame, self.held, self.sizes, self.written = [], 0, [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.held and self.held + len(record) > self.frame_bytes:
            self.end_frame()
        place = len(self.sizes), self.held
        self.frame.append(record)
        self.held += len(record)
        return place

    def end_frame(self) -> None:
        if self.held:
            data = self.compressor.compress(b"".join(self.frame))
            self.out.write(data)
            self.sizes.append((len(data), self.held))
            self.written += len(data)
            self.frame, self.held = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(file offset, compressed size, uncompressed size) of each frame of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    f.seek(size - 9 - 8 * count)
    out, at = [], 0
    for small, full in struct.iter_unpack("<II", f.read(8 * count)):
        out.append((at, small, full))
        at += small
    return out


def read_frame(f, frame: tuple[int, int, int]) -> bytes:
    f.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(f.read(frame[1]), max_output_size=frame[2])


def _batch(records: list[dict]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], t) for n, t in kinds], names=[n for n, _ in kinds])


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(``page_id, url, payload, digest, refers_to``): of equal payloads of at least ``min_bytes`` bytes the
    smallest page is referred to by the others. Payload is the html in UTF-8, null as empty."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # groups of equal payloads, one row each; staged, so that a payload that a third of the pages share
    # meets its group in a join that Spark splits
    groups = stage(rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
                   .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "payloads")
    out = rows.join(groups, "digest", "left")
    return out.select("page_id", "url", "payload", "digest",
                      F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str | None = None, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write one WARC record per row of ``pages`` (``page_id, url, html``) and return the index
    (``page_id, bundle, frame, offset, length``).

    Bundles go to ``folder`` in shared storage (by default under ``spark.checkpoint.dir``), named by task
    attempt: a repeated task writes new files, and the index names only those of the attempt that
    counted. A row with equal payload and equal page as its group's first is a response itself. Null
    url and null page are written without them; an empty table writes no bundle. Other columns are
    ignored.
    """
    spark = pages.sparkSession
    small_batches(spark, 200)
    folder = folder or scratch(spark, "warc")
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root)

    def write(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        writer, name, rows = None, None, []
        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(b.column(k).to_pylist() for k in range(5))):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(fs, f"{root}/{name}", frame_bytes)
                record = make_record(page_id, url, payload, digest, refers_to)
                rows.append((page_id, f"{folder}/{name}", *writer.add(record), len(record)))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                    names=["page_id", "bundle", "frame", "offset", "length"])
                rows = []
        if writer is not None:
            writer.close()

    return stage(with_revisits(pages).mapInArrow(write, INDEX), "warc-index")


def _open(uri: str):
    fs, path = pa.fs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names: ``page_id, url, record_type, refers_to,
    payload_digest, payload_bytes, payload`` (null for a revisit). Payloads are checked against their
    digests. A task reads one frame at a time."""
    bundles = index.select("bundle").distinct()
    parts = max(1, bundles.count())

    def read(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                with _open(uri) as f:
                    for frame in seek_table(f):
                        data, at, records = read_frame(f, frame), 0, []
                        while at < len(data):
                            record, at = parse_record(data, at)
                            records.append(record)
                        yield _batch(records)

    return bundles.repartition(parts, "bundle").mapInArrow(read, RECORD)


def fetch(index: DataFrame, page_ids: DataFrame) -> DataFrame:
    """Only the records of the given ``page_id`` rows, each by its frame and offset."""
    wanted = index.join(page_ids.select("page_id").distinct(), "page_id", "left_semi")
    wanted = wanted.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")

    def read(batches):
        for b in batches:
            uri, number, data, records = None, None, b"", []
            for at_uri, at_frame, offset in zip(*(b.column(k).to_pylist() for k in ("bundle", "frame", "offset"))):
                if (at_uri, at_frame) != (uri, number):
                    uri, number = at_uri, at_frame
                    with _open(uri) as f:
                        data = read_frame(f, seek_table(f)[number])
                records.append(parse_record(data, offset)[0])
            if records:
                yield _batch(records)

    return wanted.mapInArrow(read, RECORD)
