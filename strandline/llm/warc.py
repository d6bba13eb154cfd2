"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about FRAME bytes, each compressed on its own; a bundle
is a file of frames and, in a skippable frame at its end, the seek table: compressed and
raw size of each frame. The index maps record ids to a bundle, a frame and the record's
offset in the raw frame, so one record costs one read of the seek table and one frame.

Pages with equal payloads of at least `least` bytes are stored once: that with the largest
page_id is a response, the others are revisit records that refer to it and carry no
payload. Digests are grouped with map-side combining and joined back to their pages (one
row a digest), so that a payload in a third of all pages splits; smaller payloads are not
shuffled.

Bundles go to the shared folder through its own file system (those that pyarrow opens; s3a
and s3n count as s3). A task writes under a name of its own and only the index of a task that
succeeded is kept, so retries leave at most an unused file behind.

Null html is an empty payload (response). Pages with a null page_id are responses, unless
another page of equal payload has an id. Repeated page_ids with equal payload are all
responses if theirs is the largest. Very long pages are frames of their own; a value in Spark
has less than 2 GiB, so sizes fit the seek table's 32 bits. Other columns are not read. An
empty table gives no bundle and no rows.
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

from strandline.llm.common import shared_dir, stored, table

FRAME, BUNDLE = 1 << 18, 1 << 26
# Fixed values of the seekable format: magic numbers of skippable frame and seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{digest if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; a payload of None makes a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, and of responses the payload, of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    out = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(out["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http-length"] = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    return out | {"payload": payload}


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, raw size) of each frame."""
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    entries, at, out = struct.unpack(f"<{2 * n}I", file.read(8 * n)), 0, []
    for packed, raw in zip(entries[::2], entries[1::2], strict=True):
        out.append((at, packed, raw))
        at += packed
    return out


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3{colon}{rest}" if scheme in ("s3a", "s3n") else uri)


class Bundle:
    """Writes frames to one file; the index rows are known once it is closed."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
        self.store, self.path = file_system(self.uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.pack = self.store.open_output_stream(self.path, compression=None), zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple] = []
        self.raw, self.held, self.ids, self.at, self.total = [], 0, [], [], 0

    def add(self, rid: str, raw: bytes) -> None:
        if self.held and self.held + len(raw) > FRAME:
            self.end_frame()
        self.ids.append(rid)
        self.at.append(self.held)
        self.raw.append(raw)
        self.held += len(raw)
        self.total += len(raw)

    def end_frame(self) -> None:
        if self.raw:
            packed = self.pack.compress(b"".join(self.raw))
            self.out.write(packed)
            self.index.append((self.uri, len(self.frames), self.ids, self.at))
            self.frames.append((len(packed), self.held))
            self.raw, self.held, self.ids, self.at = [], 0, [], []

    def close(self) -> list[tuple]:
        self.end_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return self.index


INDEX = "bundle string, frame int, record_ids array<string>, offsets array<bigint>"


def typed(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to): refers_to is null for responses, payload for revisits."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("bigint")})
    large = rows.where(F.col("size") >= least)
    winners = large.groupBy(F.col("digest").alias("_digest")).agg(F.max("page_id").alias("_win"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _win is not null").drop("_n")
    winners = stored(winners, "winners")  # AQE splits hot digests in a join with a stored table only
    joined = large.join(winners, F.col("digest") == F.col("_digest"), "left")
    refers = F.when(~F.col("_win").eqNullSafe(F.col("page_id")), F.col("_win"))
    found = joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", "size", refers.alias("refers_to"))
    none = F.lit(None).cast(pages.schema["page_id"].dataType)
    return found.unionByName(rows.where(F.col("size") < least).withColumn("refers_to", none))


def write_bundles(pages: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """Writes all pages into bundles under folder; returns the index, one row a frame."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, digest, size, refers = (c[i].as_py() for c in batch.columns)
                bundle = bundle or Bundle(folder)
                bundle.add(record_id(page, digest), record(page, url, payload, digest, size, refers))
                if bundle.total >= BUNDLE:
                    yield rows_of(bundle.close())
                    bundle = None
        if bundle:
            yield rows_of(bundle.close())

    def rows_of(index: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*index, strict=True), kinds, strict=True)], names=["bundle", "frame", "record_ids", "offsets"])

    return stored(typed(pages, least).mapInArrow(write, INDEX), "warc-index")


READ = "page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def page_of(rid: str | None) -> int | None:
    value = (rid or "")[len("<urn:x-page:") : -1]
    return int(value) if len(value) < 40 and value.lstrip("-").isdigit() else None


class Frames:
    """Reads raw frames of bundles: one seek table for each run of frames of one bundle."""

    def __init__(self):
        self.bundle, self.table, self.unpack = None, [], zstandard.ZstdDecompressor()

    def __call__(self, bundle: str, frame: int) -> bytes:
        store, path = file_system(bundle)
        with store.open_input_file(path) as file:
            if bundle != self.bundle:
                self.bundle, self.table = bundle, read_seek_table(file, file.size())
            at, packed, raw_size = self.table[frame]
            file.seek(at)
            return self.unpack.decompress(file.read(packed), max_output_size=raw_size)


def read_records(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(record_id, record): the raw records whose record_id is in wanted, each from its own frame."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames()
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                raw = frames(x["bundle"], x["frame"])
                rows.append((x["record_id"], raw[x["start"] : len(raw) if x["end"] is None else x["end"]]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.binary()), strict=True)], names=["record_id", "record"])

    each = index.select("bundle", "frame", "offsets", F.posexplode("record_ids").alias("_at", "record_id"))
    spans = each.select("bundle", "frame", "record_id", F.get("offsets", F.col("_at")).alias("start"), F.get("offsets", F.col("_at") + 1).alias("end"))
    found = spans.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    return found.sortWithinPartitions("bundle", "frame").mapInArrow(read, "record_id string, record binary")


def read_bundles(index: DataFrame) -> DataFrame:
    """Every indexed record, read from its frame; responses' sizes and digests come from their payloads."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames()
        for batch in batches:
            rows: list[tuple] = []
            for x in batch.to_pylist():
                raw = frames(x["bundle"], x["frame"])
                for a, b in zip(x["offsets"], [*x["offsets"][1:], len(raw)], strict=True):
                    r = parse(raw[a:b])
                    page, kind = page_of(r["WARC-Record-ID"]), r["WARC-Type"]
                    if kind == "response":
                        rows.append((page, kind, len(r["payload"]), hashlib.sha1(r["payload"]).hexdigest(), None))
                    else:
                        rows.append((page, kind, r["http-length"], base64.b32decode(r["WARC-Payload-Digest"][5:]).hex(), page_of(r["WARC-Refers-To"])))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"])

    return index.mapInArrow(read, READ)


def op9_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return read_bundles(write_bundles(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"))
