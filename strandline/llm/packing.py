"""Packing by Karmarkar-Karp multiway differencing.

Documents become token ids (with an end id) and are cut where they fill whole windows;
what is left of each is packed in blocks of BLOCK remainders. In a block, every remainder
starts as a partial partition: one item and k - 1 empty windows. The two partitions with
the largest spread are merged, the fullest windows of one with the emptiest of the other,
until one is left, whose k windows are near equal. k starts at the least that could hold
the block. Whenever a window exceeds the capacity, k rises and the block is differenced anew: half way
to the number of windows whose fullest one would fit if it stayed as far above the mean, by one at least. So a document is cut only where it
fills a window of its own, and all windows of a block are near equal (in the first four blocks of sf0.1 1889 to 2047 ids; padding is 2.4 %).

Blocks are made inside the tasks that read the documents: nothing is shuffled, no sequence
crosses tasks, and what a task holds is one block whatever the size of the table or of
its sources. A task has one sequence at most for each block that isn't filled.

A null text is empty: its one id is the end id. A very long text is one run of ids in its
task, cut like others. Columns other than id and text are not read. Repeated rows are packed as often as they come. doc_id may be null. An empty table gives
no rows. Sequence ids hold the task's partition in their upper bits.
"""

from __future__ import annotations

import functools
import heapq
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table

BLOCK, CAPACITY, END = 1024, 2048, 1


class TextIds:
    """Ids of a byte-level BPE in the `tokenizers` JSON format.

    The vocabulary is read by that library; its ranks drive the faster encoder of `tiktoken`,
    which gives the same ids. Texts that hold one of the added tokens go to `tokenizers`.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        added = {t.content for t in self.exact.get_added_tokens_decoder().values()}
        signs = {c: b for b, c in enumerate_bytes()}
        vocabulary = self.exact.get_vocab(with_added_tokens=False).items()
        ranks = {bytes(signs[c] for c in word): rank for word, rank in vocabulary if word not in added}
        self.added = tuple(added)
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def enumerate_bytes() -> Iterator[tuple[int, str]]:
    """The characters by which byte-level vocabularies write bytes: printable ones themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = 256
    for b in range(256):
        if b in shown:
            yield b, chr(b)
        else:
            yield b, chr(rest)
            rest += 1


@functools.cache
def ids_of(path: str) -> TextIds:
    return TextIds(path)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The items of each of k windows with near-equal sums, by the largest differencing method.

    Partial partitions hold only their non-empty windows, sorted from full to empty.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    spread = lambda w: w[0][0] - (w[-1][0] if len(w) == k else 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        alone = max(k - len(b), 0)  # windows of a that meet empty ones
        shared = max(len(a) - alone, 0)
        b = b[::-1]
        windows = a[:alone] + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[alone:], b, strict=False)] + b[shared:]
        windows.sort(key=operator.itemgetter(0), reverse=True)
        heapq.heappush(heap, (-spread(windows), made, windows))
        made += 1
    found = [w[1] for w in heap[0][2]] if heap else []
    return found + [[] for _ in range(k - len(found))]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of whole items; no size may exceed the capacity."""
    total, k = sum(sizes), -(-sum(sizes) // capacity)
    while True:
        windows = [w for w in differencing(sizes, k) if w]
        over = max((sum(sizes[i] for i in w) for w in windows), default=0)
        if over <= capacity:
            return windows
        above = over - total // k  # of the fullest window, over the mean
        enough = min(-(-total // max(capacity - above, 1)), len(sizes))
        k += max((enough - k) // 2, 1)


SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and its ids."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, made = ids_of(tokenizer), TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []

        def rows_of(sequences: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal made
            rows = []
            for s in sequences:
                at = 0
                for doc, ids, start, n, tokens in s:
                    rows.append((doc, start, n, zlib.crc32(ids[:n]), tokens, base + made, at, ids[:n] if with_ids else None))
                    at += n
                made += 1
            columns = [pa.array(c) for c in list(zip(*rows, strict=True))[:7]]
            columns[0] = columns[0].cast(arrow_kind)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(np.cumsum([0, *[r[2] for r in rows]], dtype="int32"), pa.array(np.concatenate([r[7] for r in rows]).astype("int32"))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        def flush() -> Iterator[pa.RecordBatch]:
            windows = pack([len(h[1]) for h in held], capacity)
            yield rows_of([[(held[i][0], held[i][1], held[i][2], len(held[i][1]), held[i][3]) for i in w] for w in windows])
            held.clear()

        for batch in batches:
            arrow_kind = batch.schema.field(0).type
            for i in range(batch.num_rows):
                doc, value = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or ""
                ids = np.append(encode(value), np.uint32(end))
                whole = len(ids) // capacity * capacity
                if whole:
                    yield rows_of([[(doc, ids[at : at + capacity], at, capacity, len(ids))] for at in range(0, whole, capacity)])
                if whole < len(ids):
                    held.append((doc, ids[whole:].copy(), whole, len(ids)))
                if len(held) == BLOCK:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, {SCHEMA}" + ", ids array<int>" * with_ids)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences with their ids."""
    return packed(docs, tokenizer_path())
