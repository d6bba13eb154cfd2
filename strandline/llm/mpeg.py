"""Media columns: bytes kept in MPEG audio, and a parser for such streams.

The encoder makes MPEG-1 Layer III streams, 48 kHz mono, with checksums. Each frame's side
information says that both granules are empty, so that the rest of the frame is ancillary
data, which players skip: that is where the payload's bytes stand. Full frames have
320 kbit/s and the last one the lowest rate that holds what is left, so the stream has a
variable bit rate: its first frame is a table with the number of frames and bytes and 100
seek points. A tag before it says how long the payload is and was before padding.

The parser reads MPEG 1, 2 and 2.5, Layers I to III: tags before the audio (ID3v2.2 to 2.4,
unsynchronised ones too) and behind it (ID3v1, only where the last frame ends 128 bytes before the end), the table of the first frame (Xing, Info or
VBRI, with the encoder's delay and padding where given), and frame headers, resynchronising
where bytes are damaged: a header counts if one of the same kind follows where it ends, or
the audio ends there. It verifies checksums (Layers I and III; those of Layer II need its
allocation tables and are not read) and gives every frame's offset and the exact duration in
samples. Frames of free bit rate are not recognised.

Null texts are empty; null ids stay null. Every text is encoded on its own, whole, also a very
long one (its stream and payload must fit into a task's memory); equal texts give equal values
and repeated rows repeated results. Columns other than id and text are not read. Rows are
processed one by one without a shuffle, an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table
from strandline.llm.hashing import parts_by_bytes

# Fixed values of MPEG audio: kbit/s by (MPEG 1, layer) and index, sample rates of MPEG 1 by index.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
# Fixed values of a header's version field: what the sample rates are divided by; 1 is reserved.
DIVISORS = {3: 1, 2: 2, 0: 4}
#: Header, checksum and mono side information of the encoder's frames.
HEAD = 4 + 2 + 17
UNIT = 64


@functools.cache
def crc_table() -> list[int]:
    """The checksum's remainders by byte: polynomial 0x8005."""
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ (0x8005 if crc & 0x8000 else 0)
        out.append(crc & 0xFFFF)
    return out


@functools.lru_cache(1024)
def crc16(data: bytes, bits: int = -1) -> int:
    """The checksum of MPEG audio over the first bits of data (all if negative), starting from 0xFFFF."""
    crc, steps, whole = 0xFFFF, crc_table(), len(data) if bits < 0 else bits // 8
    for byte in data[:whole]:
        crc = (crc << 8 & 0xFFFF) ^ steps[crc >> 8 ^ byte]
    for i in range(max(0, bits - 8 * whole)):
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if crc >> 15 ^ data[whole] >> 7 - i & 1 else 0)
    return crc


class Header(NamedTuple):
    """One frame header; kind is what all frames of a stream share (version, layer, rate)."""

    size: int
    rate: int
    samples: int
    checked: bool
    side: int
    protected_bits: int | None
    kind: int


@functools.lru_cache(4096)
def read_header(b: bytes) -> Header | None:
    """The header in four bytes, if they are one."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer, index, rate_index = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3), b[2] >> 4, b[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3:
        return None
    first, rate = version == 3, RATES[rate_index] // DIVISORS[version]
    kbits, padding, mode = KBITS[first, layer][index], b[2] >> 1 & 1, b[3] >> 6
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12000 * kbits // rate + padding) * 4 if layer == 1 else samples // 8 * kbits * 1000 // rate + padding
    side = 0 if layer < 3 else (17 if mode == 3 else 32) if first else (9 if mode == 3 else 17)
    bound = 32 if mode != 1 else 4 * (b[3] >> 4 & 3) + 4
    protected = {1: 128 if mode == 3 else 4 * (32 + bound), 2: None, 3: 8 * side}[layer]
    return Header(size, rate, samples, not b[1] & 1, side, protected, (b[1] & 0x1E) << 8 | b[2] & 0x0C)


def header(media: bytes, at: int) -> Header | None:
    return read_header(media[at : at + 4])


@functools.lru_cache(16)
def frame_head(index: int) -> bytes:
    """Header, checksum and empty side information of the encoder's frame at the bit rate of that index."""
    start, side = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 3 << 6)), bytes(17)
    return start + struct.pack(">H", crc16(start[2:] + side)) + side


def frame_bytes(index: int) -> int:
    return read_header(frame_head(index)[:4]).size


ROOM = frame_bytes(14) - HEAD


def seven_bits(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def number(b: bytes, bits: int = 8) -> int:
    """A big-endian number of so many bits a byte."""
    return functools.reduce(lambda n, x: n << bits | x, b, 0)


def tag(fields: dict[str, str]) -> bytes:
    """An ID3v2.4 tag of TXXX fields."""
    frames = b"".join(b"TXXX" + seven_bits(len(b)) + b"\0\0" + b for b in (b"\x03" + k.encode() + b"\0" + v.encode() for k, v in fields.items()))
    return b"ID3\x04\0\0" + seven_bits(len(frames)) + frames


def tag_text(body: bytes) -> list[str]:
    """The strings of a text frame, whose first byte names their encoding."""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else 9)
    if kind is None:
        return []
    wide, raw = kind.startswith("utf-16"), body[1:]
    parts, start = [], 0
    for i in range(0, len(raw) - wide, 1 + wide):
        if not any(raw[i : i + 1 + wide]):
            parts.append(raw[start:i])
            start = i + 1 + wide
    parts.append(raw[start:])
    return [p.decode(kind, "replace") for p in parts]


def read_tag(media: bytes) -> tuple[dict[str, str], int]:
    """Text fields of all leading ID3v2 tags (TXXX by their description), and where the audio starts."""
    out: dict[str, str] = {}
    at = 0
    while media[at : at + 3] == b"ID3" and len(media) >= at + 10 and all(b < 128 for b in media[at + 6 : at + 10]):
        version, flags, end = media[at + 3], media[at + 5], at + 10 + number(media[at + 6 : at + 10], 7)
        body = media[at + 10 : end]
        if flags & 0x80 and version < 4:
            body = body.replace(b"\xff\0", b"\xff")
        if flags & 0x40 and version > 2:
            body = body[number(body[:4], 7) if version == 4 else 4 + number(body[:4]) :]
        name, head = (3, 6) if version == 2 else (4, 10)
        while len(body) > head and body[0]:
            size = number(body[name : 2 * name], 7 if version == 4 else 8)
            field, value = body[:name].decode("latin-1"), body[head : head + size]
            marks = body[9] if version == 4 else 0
            value = value[4:] if marks & 1 else value
            value = value.replace(b"\xff\0", b"\xff") if marks & 2 or (version == 4 and flags & 0x80 and not marks & 2) else value
            texts = tag_text(value) if field[0] == "T" else []
            if field in ("TXXX", "TXX") and len(texts) > 1:
                out[texts[0]] = texts[1]
            elif texts:
                out[field] = texts[0]
            body = body[head + size :]
        at = end + (10 if version == 4 and flags & 0x10 else 0)
    return out, at


def has_tail(media: bytes, at: int) -> bool:
    """Whether what follows `at` is an ID3v1 tag and nothing else."""
    return at == len(media) - 128 and media[at : at + 3] == b"TAG"


def read_tail(media: bytes, end: int) -> dict[str, str]:
    """Fields of the ID3v1 tag that starts at `end`."""
    spans = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97), "comment": (97, 127)}
    fields = {k: media[end + a : end + b].split(b"\0")[0].decode("latin-1").strip() for k, (a, b) in spans.items()}
    if media[end + 125] == 0 and media[end + 126]:
        fields["track"] = str(media[end + 126])
    return {k: v for k, v in fields.items() if v}


def read_table(media: bytes, at: int, h: Header) -> dict | None:
    """Frames, bytes, seek points, delay and padding of a table in the frame at that place, if it has one."""
    named = any(h.side and media[x : x + 4] in (b"Xing", b"Info") for x in (at + 4 + h.side, at + 6 + h.side))
    vbri = len(media) if named else at + 36
    if media[vbri : vbri + 4] == b"VBRI" and at + h.size >= vbri + 26:
        size, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", media[vbri + 10 : vbri + 26])
        raw = media[vbri + 26 : vbri + 26 + entries * width]
        points = np.cumsum([number(raw[i : i + width]) * scale for i in range(0, len(raw), width)]).tolist() if width else []
        return {"name": "VBRI", "frames": frames, "bytes": size, "points": points, "delay": number(media[vbri + 6 : vbri + 8]), "padding": 0}
    for start in (at + 4 + h.side, at + 6 + h.side):
        if h.side and media[start : start + 4] in (b"Xing", b"Info"):
            flags, p = number(media[start + 4 : start + 8]), start + 8
            out = {"name": media[start : start + 4].decode(), "frames": None, "bytes": None, "points": [], "delay": 0, "padding": 0}
            for bit, field in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[field] = number(media[p : p + 4])
                    p += 4
            if flags & 4:
                out["points"] = list(media[p : p + 100])
                p += 100
            p += 4 if flags & 8 else 0
            if media[p : p + 3] in (b"LAM", b"Lav"):
                both = number(media[p + 21 : p + 24])
                out["delay"], out["padding"] = both >> 12, both & 4095
            return out
    return None


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The stream that holds the payload; n_bytes of it are not padding."""
    full, rest = divmod(len(payload), ROOM)
    body = np.zeros((full, ROOM + HEAD), np.uint8)
    body[:, :HEAD] = np.frombuffer(frame_head(14), np.uint8)
    body[:, HEAD:] = np.frombuffer(payload, np.uint8, full * ROOM).reshape(full, ROOM)
    last = b""
    if rest:
        index = next(i for i in range(1, 15) if frame_bytes(i) - HEAD >= rest)
        last = frame_head(index) + payload[full * ROOM :]
        last += bytes(frame_bytes(index) - len(last))
    first, count = frame_bytes(3), full + bool(rest)
    total = first + body.size + len(last)
    points = bytes(min(255, (first + min(count * i // 100, full) * (ROOM + HEAD)) * 256 // total) for i in range(100))
    info = frame_head(3) + b"Xing" + struct.pack(">III", 15, count, total) + points + struct.pack(">I", 0)
    fields = {"payload-bytes": str(len(payload)), "text-bytes": str(n_bytes)}
    return tag(fields) + info.ljust(first, b"\0") + body.tobytes() + last


def next_frame(media: bytes, at: int, kind: int | None) -> tuple[int, Header] | None:
    """The first frame from `at` on: a header (of that kind, if given) that another of its kind, a closing tag or the end follows."""
    end = len(media)
    while at >= 0:
        h = header(media, at)
        if h and at + h.size <= end and kind in (None, h.kind):
            after = header(media, at + h.size)
            if at + h.size == end or (after and after.kind == h.kind) or has_tail(media, at + h.size):
                return at, h
        at = media.find(b"\xff", at + 1)
    return None


def parse(media: bytes) -> dict:
    """Tag fields, offsets and data spans of audio frames, samples, rate, table, bad checksums, resynchronisations.

    samples is the exact duration: all frames' samples less the encoder's delay and padding.
    """
    fields, at = read_tag(media)
    tail: dict[str, str] = {}
    offsets, data, bad, lost, samples, first, found = [], [], 0, 0, 0, None, None
    while at + 4 <= len(media):
        if first and has_tail(media, at):
            tail = read_tail(media, at)
            break
        frame = next_frame(media, at, first.kind if first else None)
        lost += not frame or frame[0] != at
        if not frame:
            break
        at, h = frame
        start = at + 4 + 2 * h.checked
        if h.checked and h.protected_bits is not None:
            bits = 16 + h.protected_bits
            covered = media[at + 2 : at + 4] + media[start : start + -(-h.protected_bits // 8)]
            bad += crc16(covered, bits) != number(media[at + 4 : at + 6])
        is_table = first is None and (found := read_table(media, at, h)) is not None
        first = first or h
        if not is_table:
            offsets.append(at)
            data.append((start + h.side, at + h.size))
            samples += h.samples
        at += h.size
    if found:
        samples = max(0, samples - found["delay"] - found["padding"])
    return {"fields": tail | fields, "offsets": offsets, "data": data, "samples": samples, "rate": first.rate if first else 0, "table": found, "bad": bad, "lost": lost}


def decode(media: bytes) -> tuple[bytes, dict]:
    """The payload that encode() stored, and what parse() found; a stream that holds less than its tag says is an error."""
    found = parse(media)
    whole, size = b"".join(media[a:b] for a, b in found["data"]), int(found["fields"]["payload-bytes"])
    if len(whole) < size:
        raise ValueError(f"the stream holds {len(whole)} of {size} bytes")
    return whole[:size], found


def features(found: dict, media_bytes: int) -> str:
    seek = zlib.crc32(np.asarray(found["offsets"], "<u8").tobytes())
    return f"mpeg1-layer3 rate={found['rate']} frames={len(found['offsets'])} samples={found['samples']} table={found['table']['frames']}/{found['table']['bytes']} crc_errors={found['bad']} resync={found['lost']} seek_crc32={seek:08x} bytes={media_bytes}"


COLUMNS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "samples": pa.int64(), "sample_rate": pa.int32(), "frame_offsets": pa.list_(pa.int64())}


def as_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media): each text as a stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts_by_bytes(whole, 1):
                texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
                media = [encode(t.ljust(-(-max(len(t), 1) // UNIT) * UNIT, b"\0"), len(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, media binary")


def digests(media: DataFrame) -> DataFrame:
    """(doc_id and COLUMNS) read from the media column alone: exact duration and frame offsets among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                stream = batch.column(1)[i].as_py()
                payload, found = decode(stream)
                rows.append((int(found["fields"]["text-bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stream), hashlib.sha256(stream).hexdigest(), features(found, len(stream)), found["samples"], found["rate"], found["offsets"]))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), COLUMNS.values(), strict=True)]], names=["doc_id", *COLUMNS])

    names = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int"}
    kinds = ", ".join(f"{k} {names.get(v, 'array<bigint>')}" for k, v in COLUMNS.items())
    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {kinds}")


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(as_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
