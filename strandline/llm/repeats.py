"""Suffix-array dedup: removes every byte that a repeated string of `width` bytes covers.

Suffixes of all texts are ordered by their first `width` bytes only, in most-significant-
digit passes; equal groups are the repeated strings. A pass keeps what can still be equal,
and only that goes on:

1. Digit one of a suffix is its anchor: of the DIGIT-byte strings in its first `width` bytes
   the one with the least hash (the leftmost of equals), and how far in it stands. Equal
   suffixes have equal anchors and distances. All suffixes that share an anchor's place are one
   row with a range of distances, so a text has about two rows for every width - DIGIT bytes.
   Anchors that stand at one place only end here.
2. Digit two are the bytes that a row's suffixes span together, from the first to the last.
   Rows with equal anchors, ranges and bytes are one class: all of its suffixes are repeated,
   and one of its rows stands for it from now on. Anchors with one class end here.
3. In further passes ranges are cut into PASSES[0], then PASSES[1] and at last one distance.
   The digit of a part are the bytes that all suffixes of the part have in common; parts
   whose digit is unique end. Of the others, those whose suffixes' bytes are all equal form
   classes as before. With one distance a part is a suffix, and its class all equal ones.

Every pass is sums by digit and by class with map-side combining, stored and joined back with one
row for each (AQE splits joins of stored tables, not those of sums): no group meets in a task, so a passage that a third of all texts have is one class, and
what stands around it is told apart in parallel. Digits and classes are BLAKE2b digests
of 128 bits; anchors are only hashes, as what they bring together is told apart later.

Copies of a text are counted first: a text of `width` bytes or more that occurs twice goes as a
whole. In the passes it is one text, sent packed and once per task that has it. Bytes travel in
pass 2, once per task and class; later passes look up those of the rows that are left.

Texts are compared as UTF-8 bytes; matches never cross texts. A null text is empty. Rows
with equal ids are rows of their own. Texts shorter than `width` lose nothing. Very long
texts are hashed by overlapping segments. An empty table gives no rows. op2 returns its own
columns only; the stage keeps all columns of documents.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import stored, table
from strandline.llm.hashing import Prefixes, grown, parts_by_bytes, shrink, text_bytes

WIDTH, DIGIT, SEGMENT, BATCH = 400, 128, 2 << 20, 1000
PASSES = (32, 4, 1)
#: The stage's threshold: strings of 240 bytes lead to all passages of over 50 words but those of very short words.
STAGE_WIDTH, STAGE_DIGIT, STAGE_WORDS = 240, 64, 51


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sliding_minimum(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(a)
    full = np.full(-(-n // width) * width, np.iinfo(a.dtype).max, a.dtype)
    full[:n] = a
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, digit: int) -> tuple[np.ndarray, ...]:
    """Places of all anchors in joined texts, ascending, their hashes, and the least and largest distance of their suffixes."""
    if len(data) < width:
        return np.empty(0, "i8"), np.empty(0, "u8"), np.empty(0, "i8"), np.empty(0, "i8")
    hashes = Prefixes(data).windows(digit)
    ordered = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype="u8")
    least = sliding_minimum(ordered, width - digit + 1)
    sizes = np.diff(offsets)
    inside = np.zeros(len(data) + 1, "i4")
    long = sizes >= width
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - width + 1, -1)
    suffix = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    at = (least[suffix] & np.uint64(0xFFFFFFFF)).astype("i8")
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, "i8")
    last = np.append(first[1:], len(at)) - 1
    return at[first], hashes[at[first]], (at - suffix)[last] if len(at) else first, (at - suffix)[first]


def long_anchors(data: np.ndarray, width: int, digit: int) -> tuple[np.ndarray, ...]:
    """The anchors of one very long text, by overlapping segments."""
    found = []
    for a in range(0, max(1, len(data) - width + 1), SEGMENT):
        piece = data[a : a + SEGMENT + width - 1]
        at, *rest = anchors(piece, np.array([0, len(piece)]), width, digit)
        found.append((at + a, *rest))
    at, hashes, near, far = (np.concatenate(x) for x in zip(*found, strict=True))
    places, first = np.unique(at, return_index=True)
    return places, hashes[first], np.minimum.reduceat(near, first), np.maximum.reduceat(far, first)


def packed_texts(texts: DataFrame) -> DataFrame:
    """(text_id, packed) of texts (text_id, text), each once; a task sends a text once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for batch in parts_by_bytes(whole, 1):
                rows = []
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if k not in seen:
                        rows.append((k, shrink(np.frombuffer(text.encode(), "u1"))))
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(k)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], names=["text_id", "packed"])

    return texts.mapInArrow(run, "text_id binary, packed binary").groupBy("text_id").agg(F.min("packed").alias("packed"))


def anchor_rows(texts: DataFrame, width: int, digit: int) -> DataFrame:
    """(anchor, text_id, place, near, far) of texts (text_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            keep = []
            for k in whole.column(0).to_pylist():
                keep.append(k not in seen)
                seen.add(k)
                if len(seen) > 1_000_000:
                    seen.clear()
            for batch in parts_by_bytes(whole.filter(pa.array(keep)), 1):
                data, offsets = text_bytes(batch.column(1))
                at, hashes, near, far = anchors(data, offsets, width, digit) if len(data) <= 2 * SEGMENT else long_anchors(data, width, digit)
                if len(at):
                    owner = np.searchsorted(offsets, at, "right") - 1
                    columns = [pa.array(hashes.view("i8")), batch.column(0).take(pa.array(owner)), pa.array(at - offsets[owner]), pa.array(near.astype("i4")), pa.array(far.astype("i4"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "text_id", "place", "near", "far"])

    return texts.mapInArrow(run, "anchor bigint, text_id binary, place bigint, near int, far int")


def digest(piece: bytes, anchor: int, near: int, far: int) -> bytes:
    return hashlib.blake2b(piece, digest_size=16, salt=struct.pack("<qii", anchor, near, far)).digest()


ROW = {"digit": pa.binary(), "class": pa.binary(), "anchor": pa.int64(), "text_id": pa.binary(), "place": pa.int64(), "near": pa.int32(), "far": pa.int32(), "several": pa.bool_(), "bytes": pa.binary()}
ROWS = "digit binary, class binary, anchor bigint, text_id binary, place bigint, near int, far int, several boolean, bytes binary"


def row_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), ROW.values(), strict=True)], names=list(ROW))


def contexts(texts: DataFrame, width: int) -> DataFrame:
    """ROWS of texts (text_id, packed, places): the digit is the anchor, the class all bytes of a row's suffixes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                text = grown(batch.column(1)[i].as_py(), "u1").tobytes()
                for p in batch.column(2)[i].as_py():
                    anchor, place, near, far = p["anchor"], p["place"], p["near"], p["far"]
                    piece = text[place - far : place - near + width]
                    name = digest(piece, anchor, near, far)
                    new = name not in sent
                    if len(sent) > 500_000:
                        sent.clear()
                    sent.add(name)
                    rows.append((struct.pack("<q", anchor), name, anchor, key, place, near, far, False, piece if new else None))
                    if len(rows) == BATCH:
                        yield row_batch(rows)
                        rows = []
            if rows:
                yield row_batch(rows)

    return texts.mapInArrow(run, ROWS)


def parts(rows: DataFrame, held: DataFrame, width: int, step: int) -> DataFrame:
    """ROWS of the parts of ranges, cut at multiples of step; held (text_id, place, reach, held) has the bytes from `reach` before each place on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, text, place, near, far, several, reach, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for node in range(near // step, far // step + 1):
                    low, high = node * step, node * step + step - 1
                    a, b = max(near, low), min(far, high)
                    name = digest(piece[reach - b : reach - a + width], anchor, a, b)
                    common = name if step == 1 else digest(piece[reach - low : max(reach - high + width, reach - low)], anchor, low, -step)
                    out.append((common, name, anchor, text, place, a, b, several, None))
                if len(out) >= BATCH:
                    yield row_batch(out)
                    out = []
            if out:
                yield row_batch(out)

    return rows.join(held, ["text_id", "place"]).select("anchor", "text_id", "place", "near", "far", "several", "reach", "held").mapInArrow(run, ROWS)


def told_apart(rows: DataFrame, width: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """One pass over ROWS: the spans (text_id, start, end) of its classes of several rows, and one row for each class of a digit with several.

    Rows that send bytes send them once per task and class.
    """
    rows = stored(rows, "suffixes")
    counts = stored(rows.groupBy("digit", "class").agg(F.count(F.lit(1)).alias("n")), "classes")
    repeated = counts.where("n > 1").select("class")
    spans = rows.where("not several").join(repeated, "class", "left_semi").select("text_id", (F.col("place") - F.col("far")).alias("start"), (F.col("place") - F.col("near") + width).alias("end"))
    if last:
        return spans, None
    open_ = stored(counts.groupBy("digit").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digit"), "digits")
    one = F.min(F.struct("anchor", "text_id", "place", "near", "far")).alias("_one")
    several = (F.max("several") | (F.count(F.lit(1)) > 1)).alias("several")
    return spans, rows.join(open_, "digit", "left_semi").groupBy("class").agg(one, several, F.max("bytes").alias("bytes")).select("_one.*", "several", "bytes")


def repeated_spans(keyed: DataFrame, width: int, digit: int) -> tuple[DataFrame, DataFrame]:
    """The spans (text_id, start, end) covered by repeated suffixes of texts (text_id, text), and the packed texts."""
    rows = stored(anchor_rows(keyed, width, digit), "anchors")
    place = F.xxhash64("text_id", "place")  # copies of a text in several tasks are one place
    shared = stored(rows.groupBy("anchor").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).where("_a <> _b").select("anchor"), "shared")
    places = rows.join(shared, "anchor", "left_semi").groupBy("text_id").agg(F.collect_set(F.struct("anchor", "place", "near", "far")).alias("places"))
    texts = packed_texts(keyed)
    met = texts.join(places, "text_id").select("text_id", "packed", "places")
    spans, left = told_apart(contexts(met, width), width, False)
    left = stored(left, "open")
    held = left.select("text_id", "place", F.col("far").alias("reach"), F.col("bytes").alias("held"))
    for step in PASSES:
        more, left = told_apart(parts(left.drop("bytes"), held, width, step), width, step == 1)
        spans = spans.unionByName(more)
    return spans.distinct(), texts


CUT = "text_id binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def without_spans(texts: DataFrame, keep_bytes: bool, least_words: int = 0) -> DataFrame:
    """Of texts (text_id, packed, spans array<struct<start, end>>) that lose bytes: what is removed, and what stays.

    Runs of joined spans stay if they have fewer words than least_words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts_by_bytes(whole, 1):
                rows = []
                for key, packed, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data, runs = grown(packed, "u1").tobytes(), []
                    for a, b in sorted((s["start"], s["end"]) for s in spans):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(b, runs[-1][1])
                        else:
                            runs.append([a, b])
                    if least_words:
                        runs = [r for r in runs if len(data[r[0] : r[1]].split()) >= least_words]
                    if not runs:
                        continue
                    kept = [data[a:b] for a, b in zip([0, *[r[1] for r in runs]], [*[r[0] for r in runs], len(data)], strict=True)]
                    left = b"".join(kept)
                    rows.append((key, sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore").encode() if keep_bytes else None))
                if rows:
                    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["text_id", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.mapInArrow(run, CUT)


def removals(docs: DataFrame, width: int = WIDTH, digit: int = DIGIT, keep_bytes: bool = False, least_words: int = 0) -> DataFrame:
    """(text_id, n_removed, n_spans, kept_sha256, kept) of each distinct text that loses bytes."""
    keyed = docs.select(text_key(F.col("text")).alias("text_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") >= width)
    spans, texts = repeated_spans(keyed, width, digit)
    copies = keyed.groupBy("text_id", F.octet_length("text").cast("bigint").alias("end")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    whole = copies.select("text_id", F.lit(0).cast("bigint").alias("start"), "end")
    all_spans = spans.unionByName(whole).groupBy("text_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return without_spans(texts.join(all_spans, "text_id").select("text_id", "packed", "spans"), keep_bytes, least_words)


def op2_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    data = F.coalesce("text", F.lit("")).cast("binary")
    slim = docs.select("doc_id", text_key(F.col("text")).alias("_id"), F.octet_length(data).cast("bigint").alias("n_bytes"), F.sha2(data, 256).alias("_sha"))
    cut = removals(docs)
    zero = F.lit(0).cast("bigint")
    return slim.join(cut, F.col("_id") == F.col("text_id"), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated passages of over 50 words, wherever these stand; a character cut in two goes as a whole."""
    cut = removals(docs.select("doc_id", "text"), STAGE_WIDTH, STAGE_DIGIT, True, STAGE_WORDS).select(F.col("text_id").alias("__cut_id"), F.col("kept").cast("string").alias("__cut_text"))
    joined = docs.join(cut, text_key(F.col("text")) == F.col("__cut_id"), "left")
    changed = F.col("__cut_id").isNotNull()
    new = {"text": F.when(changed, F.col("__cut_text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("__cut_text").cast("bigint")).otherwise(F.col("n_chars"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
