"""WARC archives as seekable Zstandard bundles.

A bundle holds records in independent Zstandard frames and ends with a seek table in a skippable frame (the public
seekable format: sizes of each frame, their number, a magic number). The index maps each record to its bundle, frame and
the offset inside the frame. Each task writes bundles of its own under new names; the index is a table that only tasks
that succeeded add to, so a lost executor leaves no record half written or twice in the index.

Records of equal payload: the one of smallest id is the response, others revisit it without a payload. Copies are found from digests
alone; payloads are not shuffled for it.

Defined results: null html counts as an empty payload; of repeated rows with the smallest id all are responses; a row
without an id revisits a row that has one, else is a response; an empty table writes an empty index.
"""
from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, scratch_path, written

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, BUNDLE_RECORDS = 1 << 18, 1 << 26, 1 << 16
BROADCAST_ROWS = 1_000_000
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id bigint, bundle string, frame int, offset int, length int"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC/1.1 record; a revisit has no block but tells its payload's digest and length."""
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
            "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
            f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


class Bundle:
    """A bundle while it is written."""

    def __init__(self, out):
        self.out, self.frames, self.open, self.size, self.bytes, self.records = out, [], [], 0, 0, 0
        self.packer = zstandard.ZstdCompressor(level=3)

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of one record."""
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.flush()
        at = len(self.frames), self.size
        self.open.append(data)
        self.size += len(data)
        self.records += 1
        return at

    def flush(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.bytes += len(packed)
            self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(source, size: int) -> list[tuple[int, int]]:
    """(start, packed size) of each frame, from the end of a file open for random reads."""
    source.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    source.seek(size - 9 - 8 * count)
    rows = struct.iter_unpack("<II", source.read(8 * count))
    out, at = [], 0
    for packed, _ in rows:
        out.append((at, packed))
        at += packed
    return out


def _open(folder: str):
    return fs.FileSystem.from_uri(folder)


def write_bundles(rows: DataFrame, folder: str) -> DataFrame:
    """The index of rows(page_id, url, payload, refers_to), written as bundles in folder (which all executors share)."""

    def run(batches):
        store, base = _open(folder)
        store.create_dir(base)
        bundle = name = None
        for batch in batches:
            ids, urls, payloads, refers = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for page, url, payload, refer in zip(ids, urls, payloads, refers, strict=True):
                if bundle is not None and (bundle.bytes >= BUNDLE_BYTES or bundle.records >= BUNDLE_RECORDS):
                    bundle.close()
                    bundle = None
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(store.open_output_stream(f"{base}/{name}", compression=None))
                data = record(page, url, payload or b"", refer)
                out.append((page, name, *bundle.add(data), len(data)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["page_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    return written(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, INDEX), "warc-index")


def read_bundles(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload) of each record in the index.

    A response's length and digest are taken from its payload, and its digest is held against its header."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string" + ", payload binary" * payloads

    def number(x: str) -> int | None:
        text = x.removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def run(batches):
        store, base = _open(folder)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = store.get_file_info(f"{base}/{name}").size
                with store.open_input_file(f"{base}/{name}") as source:
                    frames, at, text, out = seek_table(source, size), -1, b"", []
                    for p in sorted(places, key=lambda p: (p["frame"], p["offset"])):
                        if p["frame"] != at:
                            at = p["frame"]
                            source.seek(frames[at][0])
                            text = unpack.decompress(source.read(frames[at][1]))
                            if out:
                                yield _batch(out, payloads)
                                out = []
                        fields, block = parse(text[p["offset"] : p["offset"] + p["length"]])
                        told, refer = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields.get("WARC-Refers-To")
                        if refer is None and digest_of(block) != told:
                            raise ValueError(f"{name}: a payload differs from its digest")
                        length = len(block) if refer is None else int(fields["X-Payload-Length"])
                        out.append((number(fields["WARC-Record-ID"]), length, told, fields["WARC-Type"], None if refer is None else number(refer), fields["WARC-Target-URI"], block))
                    if out:
                        yield _batch(out, payloads)

    grouped = index.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))  # BUNDLE_RECORDS at most
    # places are few bytes for much work, so bundles are dealt by number, not by size
    tasks = max(1, min(index.select("bundle").distinct().count(), 3 * index.sparkSession.sparkContext.defaultParallelism))
    return grouped.select("bundle", "places").repartition(tasks).mapInArrow(run, schema)


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    n = 6 + payloads
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[:n], kinds[:n], strict=True)], names[:n])


def read_record(folder: str, bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place, reading the seek table and one frame only."""
    store, base = _open(folder)
    size = store.get_file_info(f"{base}/{bundle}").size
    with store.open_input_file(f"{base}/{bundle}") as source:
        start, packed = seek_table(source, size)[frame]
        source.seek(start)
        return parse(zstandard.ZstdDecompressor().decompress(source.read(packed))[offset : offset + length])


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The index of bundles in folder that hold all rows of pages, copies as revisits."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    ids = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    ids = written(ids, "page-digests")
    firsts = written(ids.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first-pages")
    revisits = join_counted(ids, firsts, ["digest", "size"], "inner").where(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")))
    revisits = written(revisits.select(F.col("page_id").alias("rid"), F.col("digest").alias("rdigest"), F.col("first").alias("refers_to")).distinct(), "revisits")
    small = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    rows = rows.join(small, F.col("page_id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
    return write_bundles(rows, folder)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for bundles among the shared ones."""
    return scratch_path(spark, "warc")
