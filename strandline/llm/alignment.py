"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which tokens share what lies between.

Both tokenizers end a token before every space that follows no white space: a byte-level BPE splits there
first, and no piece of the other holds such a space inside (checked when it is loaded). So a
text is a sequence of segments " word", equal segments have equal tokens wherever they stand,
and a text's groups are those of its segments one after the other. Only distinct segments are aligned:

1. Texts are cut, and tasks gather about BLOCK bytes of them as a block: its distinct segments and, for each
   text, their numbers in order.
2. The distinct segments of all blocks are tokenized by both, in one pass, and dealt once.
3. Relational alignment of each segment, where it is dealt to: its tokens are exploded with their positions, a
   running sum of their lengths is where they end, and an equi-join on (segment, end) finds the common
   ends. Joined with the segment's tokens they cut both sides into groups; a group is written a1,a2|b1.
4. Segments' groups go back to the blocks that asked for them (a join on the segment, each at most once a block). They
   are stored, so that what was dealt until then is deleted before a block's texts are put together from them.
5. Links of an id pair are counted by documents in each block, summed over blocks, and come
   back to the blocks that hold the pair, with whether it is its first id's most frequent one.

No key is hot: a block asks for a segment or a pair once.
A task holds one block, with its segments, or one segment's tokens. A text that has no such space is one
segment, so its own tokens meet in one task.

Null and empty texts, and texts whose tokens don't spell " " + text (one with U+2581, which reads as a
space), have no tokens: zeros and ''. Special tokens' strings are text. Very long texts
are blocks of their own. Repeated rows are documents of their own; doc_id may be null. Columns other than
id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import dropped, stored, table
from strandline.llm.hashing import grown
from strandline.llm.packing import ids_of

BLOCK, FINER = 16 << 20, 4
CUT = re.compile(r"(?<=\S)(?= )")
INSIDE = re.compile(r"\s ")


def segments(text: str) -> list[str]:
    """The segments of " " + text, each without its first space."""
    line = " " + text
    if INSIDE.search(line):
        return [s[1:] for s in CUT.split(line)]
    return line.split(" ")[1:]


class Pieces:
    """A sentencepiece model that adds a space in front: ids of segments, and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", n) for n in names):
            raise ValueError("the model has pieces with a space inside, so segments can't be tokenized on their own")
        self.bytes = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
        self.space = self.model.piece_to_id("▁")

    def __call__(self, parts: list[str]) -> list[list[int]]:
        return [ids if part else [self.space] for part, ids in zip(parts, self.model.encode(parts, num_threads=1), strict=True)]


@functools.cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


BLOCKS = "block bigint, ids array<{kind}>, sizes array<int>, numbers binary, segments array<string>"


def given_back() -> None:
    """Gives the memory that a worker's last task has left unused back to the system (as far as its C library can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(data)


def numbers_packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest ones first, which compress better."""
    return squeezed(np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T).tobytes())


def numbers_of(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(grown(packed, "u1").reshape(4, -1).T).view("<i4").ravel()


def blocks(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """BLOCKS of documents: how many segments each has (sizes), and the numbers of all, one after the other."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_back()
        number = TaskContext.get().partitionId() << 32
        ids, sizes, numbers, known, held, arrow = [], [], [], {}, 0, pa.null()

        def block() -> pa.RecordBatch:
            columns = [pa.array([number]), pa.array([ids], pa.list_(arrow)), pa.array([sizes], pa.list_(pa.int32())), pa.array([numbers_packed(np.concatenate(numbers))], pa.binary()), pa.array([list(known)], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "sizes", "numbers", "segments"])

        for batch in batches:
            arrow = batch.schema.field(0).type
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = value.as_py()
                parts = segments(own) if own else []
                ids.append(doc)
                sizes.append(len(parts))
                numbers.append(np.array([known.setdefault(p, len(known)) for p in parts], "i4"))
                held += len(own or "")
                if held >= size:
                    yield block()
                    number, ids, sizes, numbers, known, held = number + 1, [], [], [], {}, 0
        if ids:
            yield block()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, BLOCKS.format(kind=kind))


class Sides:
    """Both tokenizers' tokens of segments, and the lengths of their vocabularies in bytes."""

    def __init__(self, spark: SparkSession, first: str, second: str):
        self.paths = first, second
        known = {i: len(t) for t, i in ids_of(first).fast._mergeable_ranks.items()}
        lengths = [known.get(i, 0) for i in range(max(known) + 1)], [len(t) for t in pieces_of(second).bytes]
        self.lengths = [spark.createDataFrame(pa.table({"id": pa.array(range(len(n)), pa.int32()), "n": pa.array(n, pa.int32())})) for n in lengths]

    def tokens(self, distinct: DataFrame) -> DataFrame:
        """(segment, sides): the ids of both sides, one array each; null where a side doesn't spell the segment.

        Both are made at once, so a segment is dealt once with all its tokens.
        """
        first, second = self.paths

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given_back()
            byte_bpe, pieces = ids_of(first).fast, pieces_of(second)
            spelt_by = functools.cache(byte_bpe.decode_single_token_bytes), pieces.bytes.__getitem__
            for batch in batches:
                parts, sides = batch.column(0).to_pylist(), []  # other columns stay behind
                for part, *both in zip(parts, map(byte_bpe.encode_ordinary, [f" {p}" for p in parts]), pieces(parts), strict=True):
                    spelt = [b"".join(map(spell, ids)) for spell, ids in zip(spelt_by, both, strict=True)]
                    sides.append(both if spelt == [b" " + part.encode()] * 2 else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sides, pa.list_(pa.list_(pa.int32())))], names=["segment", "sides"])

        return distinct.mapInArrow(run, "segment string, sides array<array<int>>")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Inside, these settings hold; what is stored inside is planned and run with them."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def dealt_by_part_of_keys(spark: SparkSession):
    """Inside, rows dealt by one join key aren't dealt again for a join on that and another."""
    return settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"})


def shuffles_dropped(spark: SparkSession):
    """Inside, what a query has shuffled is deleted when it ends, not when the driver happens to collect its garbage."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def dealt_finely(spark: SparkSession):
    """Inside, exchanges have FINER times as many partitions: a task of the alignment sorts its tokens several times at once."""
    name = "spark.sql.shuffle.partitions"
    return settings(spark, {name: str(FINER * int(spark.conf.get(name)))})


def aligned(distinct: DataFrame, sides: Sides) -> DataFrame:
    """(segment, groups) of distinct segments: the groups a1,a2|b1 in order, joined by semicolons; none where a side doesn't spell the segment.

    Only vocabularies are broadcast, whose size no input changes.
    """
    in_order = Window.partitionBy("segment").orderBy("at")
    tokens = sides.tokens(distinct).repartition("segment")  # Spark runs it once for all that read it

    def ends(side: int, name: str) -> DataFrame:
        rows = tokens.select("segment", F.posexplode(F.col("sides")[side]).alias("at", "id")).join(F.broadcast(sides.lengths[side]), "id")
        return rows.select("segment", F.col("at").alias(name), F.sum("n").over(in_order).alias("end"))

    common = ends(0, "a").join(ends(1, "b"), ["segment", "end"]).groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("cuts"))

    def group(cut: Column, i: Column) -> Column:
        """The tokens of both sides from the cut before this one on."""
        before = F.when(i > 0, F.col("cuts")[i - 1]).otherwise(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b")))
        return F.concat_ws("|", *(F.array_join(F.slice(F.col("ids")[k], before[name] + 2, cut[name] - before[name]), ",") for k, name in enumerate(("a", "b"))))

    met = tokens.join(common, "segment").select("segment", "cuts", F.col("sides").cast("array<array<string>>").alias("ids"))
    return met.select("segment", F.array_join(F.transform("cuts", group), ";").alias("groups"))


def links_of(lines: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of some segments' groups: numbers of ids on both sides, groups and links of each segment, and all links as pairs in their order."""
    joined = b"\n".join(lines) + b"\n"
    signs = np.frombuffer(joined, "u1")
    signs = signs[(signs < 48) | (signs > 57)]  # one after each number
    numbers = np.fromstring(joined.translate(bytes(c if 48 <= c <= 57 else 32 for c in range(256))), "i8", sep=" ")
    closes = (signs == 59) | (signs == 10)
    group = np.cumsum(closes) - closes
    second = np.cumsum(signs == 124) - (signs == 124) > group
    n = int(closes.sum())
    na, nb = np.bincount(group[~second], minlength=n), np.bincount(group[second], minlength=n)
    last = signs[closes] == 10
    to = np.cumsum(last) - last  # the segment of each group
    per = lambda x: np.bincount(to, x, len(lines)).astype("i8")
    links = na * nb
    owner = np.repeat(np.arange(n), links)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(links) - links, links)
    a = numbers[~second][(np.cumsum(na) - na)[owner] + within // nb[owner]]
    b = numbers[second][(np.cumsum(nb) - nb)[owner] + within % nb[owner]]
    return per(na), per(nb), per(np.ones(n)), per(links), a << 32 | b


class Links:
    """The links of a block's segments, of the lines of their groups (empty: one that can't be aligned), some STEP segments at a time."""

    STEP = 30_000

    def __init__(self, packed: bytes):
        self.texts = grown(packed, "u1").tobytes().split(b"\n")
        self.broken = np.array([not t for t in self.texts], bool)
        for k in np.flatnonzero(self.broken).tolist():
            self.texts[k] = b"0|0"
        sizes, pairs, where, held = [], [], [], 0
        for at in range(0, len(self.texts), self.STEP):
            *each, found = links_of(self.texts[at : at + self.STEP])
            sizes.append(np.stack(each))
            distinct, inverse = np.unique(found, return_inverse=True)
            pairs.append(distinct)
            where.append((inverse + held).astype("i4"))
            held += len(distinct)
        self.n_a, self.n_b, self.n_groups, self.n_links = np.concatenate(sizes, axis=1)
        self.pairs, merged = np.unique(np.concatenate(pairs), return_inverse=True)
        self.where = merged.astype("i4")[np.concatenate(where)]
        self.starts = np.cumsum(self.n_links) - self.n_links

    def documents(self, docs: list[np.ndarray]) -> np.ndarray:
        """In how many of docs (their segments' numbers) each pair is linked."""
        out, mark = np.zeros(len(self.pairs), "i8"), np.zeros(len(self.pairs), bool)
        for segment in docs:
            if self.usable(segment):
                own = np.unique(segment)
                size = self.n_links[own]
                at = np.arange(int(size.sum())) + np.repeat(self.starts[own] - (np.cumsum(size) - size), size)
                mark[self.where[at]] = True
                found = np.flatnonzero(mark)
                out[found] += 1
                mark[found] = False
        return out

    def usable(self, segment: np.ndarray) -> bool:
        return len(segment) > 0 and not self.broken[segment].any()


def docs_of(sizes: list[int], numbers: bytes) -> list[np.ndarray]:
    return np.split(numbers_of(numbers), np.cumsum(sizes)[:-1]) if sizes else []


HELD = 200_000


def returned(found: DataFrame) -> DataFrame:
    """(block, at, lines) of rows (block, at, groups): many segments' numbers and groups as one row, compressed; a task holds HELD of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_back()
        held: dict[int, tuple[list, list]] = {}
        n = 0

        def sent() -> pa.RecordBatch:
            rows = [(block, numbers_packed(np.array(at)), squeezed("\n".join(lines).encode())) for block, (at, lines) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "at", "lines"])

        for batch in batches:
            for block, at, groups in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = held.get(block) or held.setdefault(block, ([], []))
                mine[0].append(at)
                mine[1].append(groups or "")
            n += batch.num_rows
            if n > HELD:
                yield sent()
                n = 0
        if held:
            yield sent()

    return found.select("block", "at", "groups").mapInArrow(run, "block bigint, at binary, lines binary")


def packed_lines(bound: DataFrame) -> DataFrame:
    """bound with the parts of `returned` as one text of lines in order of their numbers, compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_back()
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column(4)[i].as_py() or []
                lines = [line for p in parts for line in grown(p["lines"], "u1").tobytes().split(b"\n")]
                at = np.concatenate([numbers_of(p["at"]) for p in parts]) if parts else np.empty(0, "i4")
                packed = squeezed(b"\n".join([lines[k] for k in np.argsort(at).tolist()]))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[:4]), pa.array([packed], pa.binary())], names=batch.schema.names)

    kinds = {f.name: f.dataType.simpleString() for f in bound.schema} | {"texts": "binary"}
    return bound.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def pair_counts(bound: DataFrame) -> DataFrame:
    """(block, pair, n): in how many of a block's documents each pair is linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_back()
        for batch in batches:
            for i in range(batch.num_rows):
                block, sizes, numbers, texts = (c[i].as_py() for c in batch.columns)
                links = Links(texts)
                n = links.documents(docs_of(sizes, numbers))
                held = np.flatnonzero(n)
                if len(held):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), block)), pa.array(links.pairs[held]), pa.array(n[held])], names=["block", "pair", "n"])

    return bound.select("block", "sizes", "numbers", "texts").mapInArrow(run, "block bigint, pair bigint, n bigint")


FOUND = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def put_together(bound: DataFrame, kind: str, with_groups: bool) -> DataFrame:
    """doc_id and FOUND of blocks (ids, sizes, numbers, texts, stats array<struct<pair, n, best>>)."""
    names = ["doc_id", *(f.split()[0] for f in FOUND.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_back()
        for batch in batches:
            for i in range(batch.num_rows):
                ids, docs = batch.column(0)[i].values, docs_of(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                links = Links(batch.column(3)[i].as_py())
                n, best = np.zeros(len(links.pairs), "i8"), np.zeros(len(links.pairs), "i8")
                if batch.column(4)[i].is_valid:
                    pair, count, first = (np.asarray(c.to_numpy(zero_copy_only=False), "i8") for c in batch.column(4)[i].values.flatten())
                    at = np.searchsorted(links.pairs, pair)
                    n[at], best[at] = count, first
                per = lambda x: np.add.reduceat(x[links.where], links.starts)  # noqa: E731,B023
                each = [links.n_a, links.n_b, links.n_groups, links.n_links, per(best), per(n)]
                rows: list[list] = [[] for _ in range(8 if with_groups else 7)]
                for segment in docs:
                    usable = links.usable(segment)
                    for column, values in zip(rows, each, strict=False):
                        column.append(int(values[segment].sum()) if usable else 0)
                    text = b";".join([links.texts[k] for k in segment.tolist()]) if usable else b""
                    rows[6].append(hashlib.sha256(text).hexdigest() if usable else "")
                    if with_groups:
                        rows[7].append(text)
                columns = [pa.array(c, pa.int64()) for c in rows[:6]] + [pa.array(c, pa.string()) for c in rows[6:]]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=[*names, "groups"][: len(columns) + 1])

    return bound.select("ids", "sizes", "numbers", "texts", "stats").mapInArrow(run, f"doc_id {kind}, {FOUND}" + ", groups string" * with_groups)


def aligned_documents(docs: DataFrame, first: str, second: str, size: int = BLOCK, doc_id: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """doc_id and FOUND of each document; first is the path of a byte-level BPE, second that of a sentencepiece model.

    with_groups adds the groups themselves, a1,a2|b1;a3|b2,b3.
    """
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    cut = stored(blocks(docs, size, doc_id, text), "blocks", "zstd")
    # nothing is null, and a segment's first block and number are not needed: both let Spark use one exchange for the distinct segments and for those wanted
    wanted = cut.select("block", F.posexplode("segments").alias("at", "segment")).where("segment IS NOT NULL AND block IS NOT NULL").repartition("segment")
    with dealt_by_part_of_keys(spark), dealt_finely(spark), shuffles_dropped(spark):
        distinct = wanted.groupBy("segment").agg(F.min("block"), F.min("at"))
        known = aligned(distinct, Sides(spark, first, second))
        lines = stored(returned(wanted.join(known, "segment", "left")), "lines")
    with shuffles_dropped(spark):
        texts = lines.groupBy("block").agg(F.collect_list(F.struct("at", "lines")).alias("texts"))
        bound = stored(packed_lines(cut.select("block", "ids", "sizes", "numbers").join(texts, "block", "left")), "bound")
    dropped(cut)  # bound has all of it but the segments
    dropped(lines)
    held = stored(pair_counts(bound), "pairs")
    counts = held.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32))
    counts = stored(counts, "counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    stats = counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))
    back = held.select("block", "pair").join(stats, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("stats"))
    return put_together(bound.join(back, "block", "left"), kind, with_groups)


def op12_relational_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
