"""Scoring by prediction by partial matching over byte contexts.

The model is a trie of contexts of 5 to 0 bytes with the counts of what followed them in all
training texts. A byte is coded in its longest context that training has seen: with the
escape estimate of method D (a context with q distinct followers in T occurrences gives
(2 count - 1) / 2T to each and q / 2T to an escape), each escape going to the next
shorter context without the followers already ruled out, and below the empty context to an
even choice among what is left of 257 symbols (bytes and the text's end). A text's score is
the log10 probability of its bytes and its end, its first bytes having a start mark as
context.

The trie grows with the corpus and is never in one place.

1. Tasks read the documents once. Each gathers blocks of texts and stores, beside the packed
   texts, a block's distinct (context, symbol) pairs with their training counts, dealt to
   buckets by the pairs' last two bytes (GROUPS) and, so that common ones split, by the
   third last (SPLITS).
2. A bucket's counts are summed as they stream by; it holds its distinct pairs only. Those
   of a bucket have all contexts of three bytes and more that they escape to. The pairs of
   two-byte contexts (257**3 at most) are summed by group, those of shorter ones
   (257**2 + 257 at most) for all, which is small enough to be broadcast.
3. A bucket's model and then the blocks' questions come sorted to one task, which answers
   each with the code lengths of its pairs. A block's answers and its packed texts meet in
   the same way. Words of the unigram baseline go along, by their hash.

Blocks grow with the fourth root of the corpus and buckets with the root of the number of
blocks, so the rows of step 1 (blocks times buckets) hold hundreds of pairs each at any size.
Partitions are as many as buckets and blocks, so no task grows with the corpus but by the pairs of
its bucket. Neither depends on sources or copies.

Null texts are empty: one end. A very long text is a block of its own. Rows with equal ids
are scored as often as they come, rows without an id count as training rows. An empty
table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import stored, table
from strandline.llm.hashing import WordIds, grown, mix, new_key, parts_by_bytes, shrink, steps, text_bytes, word_ids

ORDER, BITS, MARK, ALPHABET, BLOCK, SPLITS = 5, 9, 256, 257, 16 << 20, 8
END_WORD = np.uint64(0x1CEB00DA5EED)
Counts = tuple[np.ndarray, np.ndarray]
NONE: Counts = (np.empty(0, "u8"), np.empty(0, "i8"))


def low(keys: np.ndarray, symbols: int) -> np.ndarray:
    """The last `symbols` symbols of codes."""
    return keys & np.uint64((1 << symbols * BITS) - 1)


def pairs(data: np.ndarray, offsets: np.ndarray, numbers: np.ndarray | None = None, base: int = 1 << BITS) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (context, symbol) at every byte and end of joined texts, and the texts' offsets among them.

    A code holds ORDER + 1 symbols of BITS bits, the last of them the one that follows; given numbers of symbols below a base, these.
    """
    n, sizes = len(offsets) - 1, np.diff(offsets)
    starts = offsets[:-1] + np.arange(n) * (ORDER + 1)
    marked, own = np.full(len(data) + n * (ORDER + 1), MARK, "u8"), np.ones(len(data) + n * (ORDER + 1), bool)
    own[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    own[starts + ORDER + sizes] = False
    marked[own] = data
    if numbers is not None:
        marked = numbers[marked]
    two = marked[:-1] * np.uint64(base) + marked[1:]
    code = (two[:-4] * np.uint64(base**2) + two[2:-2]) * np.uint64(base**2) + two[4:]  # ORDER + 1 are three twos
    follows = np.ones(len(code), bool)
    follows[(starts[1:, None] - ORDER + np.arange(ORDER)).ravel()] = False
    return code[follows], np.concatenate([[0], np.cumsum(sizes + 1)])


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value of an ordered array comes first."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, "i8")


def places_of_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts' pairs: the distinct codes, ascending, how often each comes, the places of all in that order, and the texts' offsets among them.

    Numbers of the symbols that occur make codes so short that a code and its place are one number, which sorts
    several times faster than places by their codes do.
    """
    symbols = np.append(np.flatnonzero(np.bincount(data, minlength=MARK)), MARK).astype("u8")
    numbers = np.zeros(ALPHABET, "u8")
    numbers[symbols] = np.arange(len(symbols))
    room = int(len(data) + len(offsets) - 2).bit_length()
    if len(symbols) ** (ORDER + 1) > 1 << (64 - room):
        code, ends = pairs(data, offsets)
        at = np.argsort(code)
        code = code[at]
        first = firsts(code)
        return code[first], np.diff(first, append=len(code)), at, ends
    code, ends = pairs(data, offsets, numbers, len(symbols))
    code <<= np.uint64(room)
    code |= np.arange(len(code), dtype="u8")
    code.sort()
    at = (code & np.uint64((1 << room) - 1)).astype("i8")
    code >>= np.uint64(room)
    first = firsts(code)
    rest, distinct = code[first], np.zeros(len(first), "u8")
    for j in range(ORDER + 1):
        rest, number = np.divmod(rest, np.uint64(len(symbols)))
        distinct |= symbols[number] << np.uint64(j * BITS)
    return distinct, np.diff(first, append=len(code)), at, ends


def counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> Counts:
    """Distinct keys, ascending, and the sums of their counts."""
    if not keys:
        return NONE
    every = np.concatenate(keys)
    by = np.argsort(every, kind="stable")  # fast where keys come in ordered runs
    every = every[by]
    first = firsts(every)
    return every[first], np.add.reduceat(np.concatenate(counts)[by], first).astype("i8") if len(first) else NONE[1]


def with_training(keys: np.ndarray, trains: np.ndarray) -> Counts:
    """Distinct keys, and how often each comes where trains is true."""
    every, seen = np.sort(keys), np.sort(keys[trains])
    every = every[firsts(every)]
    first = firsts(seen)
    count = np.zeros(len(every), "i8")
    count[np.searchsorted(every, seen[first])] = np.diff(first, append=len(seen))
    return every, count


def pairs_with_training(codes: np.ndarray, trains: np.ndarray) -> Counts:
    """with_training of codes of pairs, sorted once: they leave a bit for trains."""
    both = codes << np.uint64(1) | trains
    both.sort()
    counts = (both & np.uint64(1)).astype("i8")
    both >>= np.uint64(1)
    first = firsts(both)
    return both[first], np.add.reduceat(counts, first) if len(first) else NONE[1]


def of(keys: np.ndarray, table_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of keys in a sorted table, 0 where it lacks them."""
    if not len(table_keys):
        return np.zeros(len(keys), values.dtype)
    at = np.minimum(np.searchsorted(table_keys, keys), len(table_keys) - 1)
    return np.where(table_keys[at] == keys, values[at], values.dtype.type(0))


def bucket_of_pairs(keys: np.ndarray, groups: int) -> np.ndarray:
    last_two, third = low(keys >> np.uint64(BITS), 2), low(keys >> np.uint64(3 * BITS), 1)
    return (mix(last_two + np.uint64(1)) % np.uint64(groups) * np.uint64(SPLITS) + mix(third + np.uint64(1 << 20)) % np.uint64(SPLITS)).astype("i4")


def bucket_of_words(keys: np.ndarray, groups: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(groups * SPLITS)).astype("i4")


class Trie:
    """Contexts of ORDER to 0 symbols with their followers' counts, each order's pairs sorted."""

    def __init__(self, long: Counts, two: Counts, short: Counts):
        """long: pairs of full contexts; two: of two symbols, short: of one, both of the whole corpus for what is in long."""
        self.pairs = [long, *[counted([low(long[0], k + 1)], [long[1]]) for k in range(ORDER - 1, 2, -1)], two, short, counted([low(short[0], 1)], [short[1]])]
        self.contexts = []
        for i, (keys, counts) in enumerate(self.pairs):
            context = keys >> np.uint64(BITS)
            starts = firsts(context)
            sums = lambda x, at=starts: np.add.reduceat(x, at) if len(at) else np.empty(0, "i8")
            lower = of(low(keys, ORDER - i), *self.pairs[i + 1]) if i < ORDER else np.zeros(len(keys), "i8")
            self.contexts.append((context[starts], sums(counts), np.diff(np.append(starts, len(keys))), sums(lower)))

    def code_lengths(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each (context, symbol)."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        ruled_out, ruled_n = np.zeros(len(keys), "i8"), np.zeros(len(keys), "i8")
        for i, (pair, counts) in enumerate(self.pairs):
            k = low(keys[open_], ORDER - i + 1)
            n = of(k, pair, counts)
            context, total, distinct, lower = self.contexts[i]
            k >>= np.uint64(BITS)
            at = np.minimum(np.searchsorted(context, k), max(len(context) - 1, 0))
            known = context[at] == k if len(context) else np.zeros(len(k), bool)
            t, q = (np.where(known, x[at] if len(x) else 0, 0) for x in (total, distinct))
            t_left, q_left = t - ruled_n, q - ruled_out
            here = n > 0
            out[open_[here]] += np.log10((2 * n[here] - 1) / (2 * t_left[here]))
            away = ~here & (q_left > 0)
            out[open_[away]] += np.log10(q_left[away] / (2 * t_left[away]))
            ruled_out, ruled_n = q[~here], np.where(known, lower[at] if len(lower) else 0, 0)[~here]
            open_ = open_[~here]
        out[open_] -= np.log10(ALPHABET - ruled_out)
        return out


def packed_keys(keys: np.ndarray) -> bytes:
    return shrink(steps(keys))


def keys_of(data: bytes) -> np.ndarray:
    return np.cumsum(grown(data, "u8"), dtype="u8")


ASKED = "block bigint, bucket int, pair_keys binary, pair_counts binary, word_keys binary, word_counts binary, texts binary, sizes binary, trains binary"


def asked(docs: DataFrame, groups: int, block_bytes: int, key: bytes) -> DataFrame:
    """Of docs (doc_id, text, trains): rows of packed texts (doc_ids, texts, sizes, trains) by block, and of pairs and words by block and bucket."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 7)
    names = ["block", "bucket", "pair_keys", "pair_counts", "word_keys", "word_counts", "texts", "sizes", "trains", "doc_ids"]

    def rows_of(rows: list[tuple], doc_ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], doc_ids], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        found: tuple[list, ...] = ([], [], [], [])
        ids = WordIds(key)

        def questions() -> pa.RecordBatch:
            keys, counts = counted(found[0], found[1])
            words, word_counts = counted(found[2], found[3])
            to, word_to = bucket_of_pairs(keys, groups), bucket_of_words(words, groups)
            by, word_by = np.argsort(to, kind="stable"), np.argsort(word_to, kind="stable")
            every = np.arange(groups * SPLITS + 1)
            cut, word_cut = np.searchsorted(to[by], every).tolist(), np.searchsorted(word_to[word_by], every).tolist()
            rows = []
            for b in range(groups * SPLITS):
                p, w = by[cut[b] : cut[b + 1]], word_by[word_cut[b] : word_cut[b + 1]]
                if len(p) or len(w):
                    rows.append((block, b, packed_keys(keys[p]), shrink(counts[p]), packed_keys(words[w]), shrink(word_counts[w]), None, None, None))
            for x in found:
                x.clear()
            return rows_of(rows, pa.nulls(len(rows), pa.list_(doc_type)))

        for whole in batches:
            doc_type = whole.schema.field(0).type
            for batch in parts_by_bytes(whole, 1):
                data, offsets = text_bytes(batch.column(1))
                trains = batch.column(2).to_numpy(zero_copy_only=False)
                code, ends = pairs(data, offsets)
                word, first = word_ids(data, offsets, ids)
                word = np.concatenate([word, np.full(len(trains), END_WORD)])
                new = *pairs_with_training(code, np.repeat(trains, np.diff(ends))), *with_training(word, np.concatenate([np.repeat(trains, np.diff(first)), trains]))
                for held, x in zip(found, new, strict=True):
                    held.append(x)
                doc_ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
                yield rows_of([(block, None, None, None, None, None, shrink(data), shrink(np.diff(offsets)), trains.tobytes())], doc_ids)
                size += len(code)
                if size >= block_bytes:
                    yield questions()
                    block, size = block + 1, 0
        if size:
            yield questions()

    return docs.select("doc_id", "text", "trains").mapInArrow(run, f"{ASKED}, doc_ids array<{kind}>")


MODEL = "bucket int, pair_keys binary, pair_counts binary, word_keys binary, word_counts binary, tokens bigint, kinds bigint"
HELD = 1 << 22


class Sums:
    """Counts by key, summed whenever HELD have come."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        seen = counts > 0
        self.keys.append(keys[seen])
        self.counts.append(counts[seen])
        self.size += len(self.keys[-1])
        if self.size > HELD + 2 * len(self.keys[0]):
            keys, counts = self.all()
            self.keys, self.counts, self.size = [keys], [counts], len(keys)

    def all(self) -> Counts:
        return counted(self.keys, self.counts)


def model(asked_rows: DataFrame, groups: int) -> DataFrame:
    """The training counts of each bucket's pairs and words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, pair, word = None, Sums(), Sums()

        def summed() -> pa.RecordBatch:
            (keys, counts), (words, number) = pair.all(), word.all()
            row = [[bucket], [packed_keys(keys)], [shrink(counts)], [packed_keys(words)], [shrink(number)], [int(number.sum())], [len(words)]]
            kinds = (pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=["bucket", "pair_keys", "pair_counts", "word_keys", "word_counts", "tokens", "kinds"])

        for batch in batches:
            for b, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and bucket is not None:
                    yield summed()
                    pair, word = Sums(), Sums()
                bucket = b
                pair.add(keys_of(packed[0]), grown(packed[1], "i8"))
                word.add(keys_of(packed[2]), grown(packed[3], "i8"))
        if bucket is not None:
            yield summed()

    rows = asked_rows.where("bucket is not null").select("bucket", "pair_keys", "pair_counts", "word_keys", "word_counts")
    return rows.repartition(groups * SPLITS, "bucket").sortWithinPartitions("bucket").mapInArrow(run, MODEL)


def two_symbol_pairs(buckets: DataFrame) -> DataFrame:
    """(group, keys, counts) of the contexts of two symbols, summed over the splits of each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sums = None, Sums()

        def summed() -> pa.RecordBatch:
            keys, counts = sums.all()
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([packed_keys(keys)]), pa.array([shrink(counts)])], names=["group", "keys", "counts"])

        for batch in batches:
            for g, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group and group is not None:
                    yield summed()
                    sums = Sums()
                group = g
                sums.add(*counted([low(keys_of(k), 3)], [grown(n, "i8")]))
        if group is not None:
            yield summed()

    rows = buckets.select((F.col("bucket") / SPLITS).cast("int").alias("group"), "pair_keys", "pair_counts")
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "group int, keys binary, counts binary")


def one_symbol_pairs(two: DataFrame) -> Counts:
    """The pairs of contexts of one symbol, 257**2 at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.add(*counted([low(keys_of(k), 2)], [grown(n, "i8")]))
        keys, counts = sums.all()
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype("i8")), pa.array(counts)], names=["key", "n"])

    found = two.select("keys", "counts").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return counted([found["key"].to_numpy().astype("u8")], [found["n"].to_numpy()])


ANSWER = "block bigint, pair_keys binary, pair_values binary, word_keys binary, word_values binary"


def answers(asked_rows: DataFrame, buckets: DataFrame, two: DataFrame, one: Counts, groups: int) -> DataFrame:
    """Code lengths and training counts beside the keys that each block asked for."""
    sent = asked_rows.sparkSession.sparkContext.broadcast(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, trie, parts, words = None, None, {}, NONE
        for batch in batches:
            rows = []
            for b, kind, block, pair_keys, pair_counts, word_keys, word_counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    bucket, trie, parts, words = b, None, {}, NONE
                if kind < 2:
                    parts[kind] = (keys_of(pair_keys), grown(pair_counts, "i8"))
                    if kind == 0:
                        words = (keys_of(word_keys), grown(word_counts, "i8"))
                    continue
                trie = trie or Trie(parts.get(0, NONE), parts.get(1, NONE), sent.value)
                lengths = trie.code_lengths(keys_of(pair_keys)).astype("f4")
                rows.append((block, pair_keys, shrink(lengths), word_keys, shrink(of(keys_of(word_keys), *words))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)], names=["block", "pair_keys", "pair_values", "word_keys", "word_values"])

    no_block, nothing = F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("binary")
    known = buckets.select("bucket", F.lit(0).alias("kind"), no_block, "pair_keys", "pair_counts", "word_keys", "word_counts")
    each = two.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("split"))
    spread = each.select(F.col("group") * SPLITS + F.col("split"), F.lit(1), no_block, "keys", "counts", nothing, nothing)
    wanted = asked_rows.where("bucket is not null").select("bucket", F.lit(2), "block", "pair_keys", nothing, "word_keys", nothing)
    return known.union(spread).union(wanted).repartition(groups * SPLITS, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, ANSWER)


def scored(asked_rows: DataFrame, replies: DataFrame, n: int, v: int, kind: str, blocks: int, key: bytes) -> DataFrame:
    """The scores of all documents: a block's answers come before its texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, given, lengths, known, ids = None, [], NONE, NONE, WordIds(key)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            for i, (b, is_text, *packed) in enumerate(zip(*columns, strict=True)):
                if b != block:
                    block, given = b, []
                if not is_text:
                    given.append([keys_of(packed[0]), grown(packed[1], "f4"), keys_of(packed[2]), grown(packed[3], "i8")])
                    continue
                if given:
                    joined = [np.concatenate(x) for x in zip(*given, strict=True)]
                    by, word_by = np.argsort(joined[0]), np.argsort(joined[2])
                    lengths, known, given = (joined[0][by], joined[1][by]), (joined[2][word_by], joined[3][word_by]), []
                data, sizes, trains = grown(packed[0], "u1"), grown(packed[1], "i8"), np.frombuffer(packed[2], bool)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                distinct, sizes, at, ends = places_of_pairs(data, offsets)
                each = np.empty(len(at))
                each[at] = np.repeat(of(distinct, *lengths).astype("f8"), sizes)
                score = np.add.reduceat(each, ends[:-1])
                word, first = word_ids(data, offsets, ids)
                distinct, inverse = np.unique(np.append(word, END_WORD), return_inverse=True)
                count = of(distinct, *known)[inverse]
                part = np.log10((count + 1) / (n + v + 1))
                sums, seen = np.concatenate([[0.0], np.cumsum(part[:-1])]), np.concatenate([[0], np.cumsum(count[:-1] > 0)])
                values = [~trains, np.diff(first) + 1, seen[first[1:]] - seen[first[:-1]] + (count[-1] > 0), np.full(len(trains), n), sums[first[1:]] - sums[first[:-1]] + part[-1], score]
                yield pa.RecordBatch.from_arrays([batch.columns[-1][i].values, *map(pa.array, values)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    nothing = F.lit(None)
    texts = asked_rows.where("bucket is null").select("block", F.lit(1).alias("is_text"), F.col("texts").alias("a"), F.col("sizes").alias("b"), F.col("trains").alias("c"), nothing.cast("binary").alias("d"), "doc_ids")
    given = replies.select("block", F.lit(0), "pair_keys", "pair_values", "word_keys", "word_values", nothing.cast(f"array<{kind}>"))
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return given.union(texts).toDF(*texts.columns).repartition(blocks, "block").sortWithinPartitions("block", "is_text").mapInArrow(run, schema)


def ppm_scores(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """Scores of docs (doc_id, text); documents with crc32(doc_id) mod 7 = 2 are held out of training."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 1
    block_bytes = int(block_bytes * max(1.0, total / 2**30) ** 0.25)
    blocks = -(-total // block_bytes)
    groups = max(1, round(3 * blocks**0.5))
    key = new_key()
    trains = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    every = stored(asked(docs.select("doc_id", text.alias("text"), trains.alias("trains")), groups, block_bytes, key), "asked")
    buckets = stored(model(every, groups), "model")
    two = stored(two_symbol_pairs(buckets), "two")
    n, v = buckets.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    return scored(every, answers(every, buckets, two, one_symbol_pairs(two), groups), n, v, kind, blocks, key)


def op7_ppm_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
