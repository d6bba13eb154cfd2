"""N-gram Jaccard join by an R-tree over count vectors.

A document's set holds its distinct n-word shingles; documents with equal sets form a
class. Two classes are linked when their sets' Jaccard similarity reaches the threshold.

Candidates. Sets that reach the threshold differ in k shingles at most, k following from
their sizes. Shingles are hashed into groups, more of them than k (see `group_keys`), so
two such sets agree in one group at least: every set emits the hash of each group's
content, and pairs are looked for among the sets that share one. Sizes fall into ranges;
a set emits for its own range and, if a partner may be larger, for the next.

Joining. Each set is a point: how many of its shingles each of DIMENSIONS other groups has
(or more for long sets: their vectors fold to fewer by adding up).
The points that share a key go into a packed R-tree whose nodes keep their coordinates'
maxima and the least size. The overlap with any set below a node is at most the sum of the
smaller coordinates, so nodes and points whose sum is too small for the threshold are
passed by. What is within reach is connected to families, by connected components over a
spanning forest for each key; the sets of a family are then joined in the same way, each
surviving pair being verified on the sets and then on the words themselves, unless it is
connected already. So thousands of near copies take about one verification each, and no
key emits its pairs.

Equal sets meet only in sums with map-side combining and in joins with one row a class,
which AQE splits; a text is sent once for each task that has it, not once for each copy.

Upper and lower case differ only beyond A-Z. Null, empty and blank texts have empty sets,
linked with nothing. Documents shorter than n words have one shingle, their whole sequence.
Rows with equal ids are rows of their own; component_id is the smallest id of the group
(null if it has none). An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import aside, dropped, restored, stored, table
from strandline.llm.components import components
from strandline.llm.hashing import WordIds, grown, mix, new_key, parts_by_bytes, shrink, steps, text_bytes, word_ids

DIMENSIONS, FANOUT, BUCKET = 128, 16, 8 << 20


def shingle_sets(column: pa.Array, n: int, known: WordIds) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; upper-case A-Z count as lower-case."""
    word, first = word_ids(*text_bytes(column), known)
    if len(word) >= n:
        m = len(word) - n + 1
        with np.errstate(over="ignore"):
            grams = word[:m].copy()
            for j in range(1, n):
                grams = mix(grams * np.uint64(0x9FB21C651E98DF25) + word[j : j + m])
    else:
        grams = np.empty(0, "u8")
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield np.frombuffer(hashlib.blake2b(word[a:b].tobytes(), digest_size=8).digest(), "u8")
        else:
            yield np.empty(0, "u8")


@functools.cache
def range_ratio(percent: int) -> float:
    return (100 / percent) ** (3 if percent >= 88 else 2)


@functools.cache
def groups_for(level: int, percent: int) -> tuple[int, int]:
    """How many groups sets of that range of sizes are dealt to, and the most shingles k in which two may differ.

    There are k + 1 groups and some more: enough that a set of the largest size uses more
    than k, by three deviations.
    """
    top = math.ceil(range_ratio(percent) ** (level + 1))
    k = math.floor(2 * top * (100 - percent) / (100 + percent) + 1e-9)
    groups = k + 1
    while groups * -math.expm1(-top / groups) - 3 * math.sqrt(groups * math.exp(-top / groups)) < k + 0.5 and groups < 4 * (k + 1):
        groups += 1
    return groups, k


def group_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """A key for the content of each non-empty group, for the ranges the set belongs to.

    Sets that link differ in fewer shingles than there are groups, so some group is equal in
    both. If that is never one with shingles, every group that either set uses differs, and
    neither uses more groups than it may have differences: such sets emit empty groups too.
    """
    n, ratio = len(shingles), range_ratio(percent)
    level = max(0, math.floor(math.log(n) / math.log(ratio)) - 1)
    while math.ceil(ratio ** (level + 1)) < n:
        level += 1
    levels = [level]
    while math.ceil(ratio ** (levels[-1] + 1)) < n * 100 // percent:
        levels.append(levels[-1] + 1)
    out = []
    with np.errstate(over="ignore"):
        spread = mix(shingles + np.uint64(0x632BE59BD9B4E019))
        for level in levels:
            p, k = groups_for(level, percent)
            group = ((spread >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)).astype("i8")
            order = np.argsort(group, kind="stable")
            count = np.bincount(group, minlength=p)
            sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(mix(spread ^ np.uint64(0x85EBCA6B))[order])])
            ends = np.cumsum(count)
            total = sums[ends] - sums[ends - count]
            used = np.flatnonzero(count)
            if len(used) <= min(k, n * (100 - percent) // percent):
                used = np.arange(p)
            out.append(mix(total[used] * np.uint64(3) + count[used].astype("u8") + mix(used.astype("u8") + np.uint64((level + 1) << 32))))
    return np.concatenate(out)


SETS = "n_shingles bigint, set_key binary, set_id bigint, text_md5 string, vector binary, bucket int, keys binary, ids binary"
HELD_KEYS = 1 << 20


def shingled(docs: DataFrame, n: int, percent: int, buckets: int, key: bytes) -> DataFrame:
    """doc_id, size and key of each document's set; and rows of group keys with their set ids, packed by bucket.

    key: that of the words' ids, one for all tasks.

    Vector and keys of a set are sent when a task meets it for the first time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
    names = ["n_shingles", "set_key", "set_id", "text_md5", "vector", "bucket", "keys", "ids"]

    def packed(keys: list[np.ndarray], ids: list[int], doc_type: pa.DataType) -> pa.RecordBatch:
        every, owner = np.concatenate(keys), np.repeat(np.array(ids, "i8"), [len(k) for k in keys])
        order = np.argsort(every)
        every, owner = every[order], owner[order]
        bucket = (every >> np.uint64(32)).astype("i8") * buckets >> 32
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = [(b, shrink(steps(every[x:y])), shrink(owner[x:y])) for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if y > x]
        none = [[None] * len(rows)] * 5
        columns = [*none, *zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.nulls(len(rows), doc_type), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        known = WordIds(key)
        held_keys, held_ids, held = [], [], 0
        for whole in batches:
            doc_type = whole.schema.field(0).type
            for batch in parts_by_bytes(whole, 1):
                sizes, digests, ids, vectors = [], [], [], []
                for s in shingle_sets(batch.column(1), n, known):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                    sizes.append(len(s))
                    digests.append(digest)
                    ids.append(int.from_bytes(digest[:8], "little", signed=True) if digest else None)
                    vectors.append(None)
                    if digest is not None and digest not in seen:
                        vectors[-1] = count_vector(s, dimensions_for(len(s))).tobytes()
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(digest)
                        held_keys.append(group_keys(s, percent))
                        held_ids.append(ids[-1])
                        held += len(held_keys[-1])
                        if held > HELD_KEYS:
                            yield packed(held_keys, held_ids, doc_type)
                            held_keys, held_ids, held = [], [], 0
                m = len(sizes)
                columns = [sizes, digests, ids, batch.column(2), vectors, [None] * m, [None] * m, [None] * m]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *names])
        if held:
            yield packed(held_keys, held_ids, doc_type)

    rows = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
    return rows.mapInArrow(run, f"doc_id {kind}, {SETS}")


def shared_keys(packed: DataFrame) -> DataFrame:
    """(key, set_id) of all keys that several sets have, each distinct group of sets once.

    A bucket's rows are merged as they come; what is kept is each key once, with its first set,
    and what is shared. Near copies share many keys: a key is renamed after its sets, so that all
    keys of the same sets become one. A bucket that shares too much to wait for its end keeps
    its keys' own names.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keys, ids, size = None, [], [], 0
        shared: list[tuple[np.ndarray, np.ndarray]] = []
        waiting, renames = 0, True

        def given_out() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            waiting = 0
            if not shared:
                return
            key, member = (np.concatenate(x) for x in zip(*shared, strict=True))
            shared.clear()
            order = np.lexsort([member, key])
            key, member = key[order], member[order]
            one = np.concatenate([[True], (key[1:] != key[:-1]) | (member[1:] != member[:-1])])
            key, member = key[one], member[one]
            if renames:
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                counts = np.diff(np.append(starts, len(key)))
                with np.errstate(over="ignore"):
                    names = mix(np.add.reduceat(mix(member.view("u8") + np.uint64(0x2545F4914F6CDD1D)), starts) + counts.astype("u8"))
                new = np.zeros(len(names), bool)
                new[np.unique(names, return_index=True)[1]] = True
                pick = np.repeat(new, counts)
                key, member = np.repeat(names, counts)[pick], member[pick]
            yield pa.RecordBatch.from_arrays([pa.array(key.view("i8")), pa.array(member)], names=["key", "set_id"])

        def merged() -> Iterator[pa.RecordBatch]:
            nonlocal keys, ids, size, waiting, renames
            every, owner = np.concatenate(keys), np.concatenate(ids)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            new = np.concatenate([[True], every[1:] != every[:-1]])
            first = owner[np.maximum.accumulate(np.where(new, np.arange(len(every)), 0))]
            other = first != owner
            keys, ids, size = [every[new]], [owner[new]], 0
            if other.any():
                shared.append((np.concatenate([every[other]] * 2), np.concatenate([first[other], owner[other]])))
                waiting += len(shared[-1][0])
                if waiting > 2 * HELD_KEYS:
                    renames = False
                    yield from given_out()

        for batch in batches:
            for b, k, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket or size > 2 * HELD_KEYS:
                    if keys:
                        yield from merged()
                    if b != bucket:
                        yield from given_out()
                        bucket, keys, ids, size, renames = b, [], [], 0, True
                keys.append(np.cumsum(grown(k, "u8"), dtype="u8"))
                ids.append(grown(i, "i8"))
                size += len(ids[-1])
        if keys:
            yield from merged()
        yield from given_out()

    rows = packed.where("bucket is not null").select("bucket", "keys", "ids")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key bigint, set_id bigint").distinct()


def dimensions_for(size: int) -> int:
    """A power of two that leaves about ten shingles to a dimension: fewer dimensions tell long sets apart too badly."""
    return min(max(DIMENSIONS, 1 << (max(size, 1) // 10).bit_length()), 1 << 15)


def count_vector(shingles: np.ndarray, dimensions: int) -> np.ndarray:
    """How many of a set's shingles each of the dimensions has."""
    counts = np.bincount((shingles & np.uint64(dimensions - 1)).astype("i8"), minlength=dimensions)
    return counts.astype("<u4")


def vectors_of(stored_bytes: list[bytes]) -> np.ndarray:
    """Stored vectors as rows, the longer ones folded to the shortest's dimensions."""
    each = [np.frombuffer(b, "<u4") for b in stored_bytes]
    dimensions = min(map(len, each))
    return np.stack([v.reshape(-1, dimensions).sum(0) for v in each]).astype("i4")


def near_points(points: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between sets of one key whose vectors' bound reaches the threshold; a spanning forest for each key.

    points (key, set_id, vector) are sorted by key.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        edges: list[tuple[int, int]] = []

        def join() -> None:
            if len(held) > 1:
                ids, vectors = list(held), vectors_of(list(held.values()))
                edges.extend((ids[i], ids[j]) for i, j in forest(vectors, vectors.sum(1), percent, None))

        for batch in batches:
            for k, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    join()
                    key, held = k, {}
                held[i] = v
            if len(edges) > 100_000:
                yield edge_rows(edges)
                edges.clear()
        join()
        if edges:
            yield edge_rows(edges)

    def edge_rows(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.unique(np.array(edges, "i8"), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return points.mapInArrow(run, "a bigint, b bigint")


class CountTree:
    """A packed R-tree over count vectors; points are ordered by size, then by coordinates."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort([*vectors.T[::-1], sizes])
        self.levels = [(vectors[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > FANOUT:
            v, s = self.levels[-1]
            cuts = np.arange(0, len(s), FANOUT)
            self.levels.append((np.maximum.reduceat(v, cuts), np.minimum.reduceat(s, cuts)))

    def query(self, vector: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose overlap with the vector may reach the threshold: 100 * o >= percent * (size + other - o)."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            v, s = self.levels[depth]
            bound = np.minimum(v[at], vector).sum(1)
            at = at[(100 + percent) * bound >= percent * (size + s[at])]
            if depth:
                below = len(self.levels[depth - 1][1])
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < below]
        return self.order[at]


def forest(vectors: np.ndarray, sizes: np.ndarray, percent: int, linked) -> list[tuple[int, int]]:
    """Edges that connect just what pairs within reach connect: the bound must reach the threshold, and linked(i, j) hold if given."""
    n = len(sizes)
    if n == 2:
        within = (100 + percent) * np.minimum(vectors[0], vectors[1]).sum() >= percent * sizes.sum()
        return [(0, 1)] if within and (linked is None or linked(0, 1)) else []
    tree, label, members, out = CountTree(vectors, sizes), np.arange(n), {i: [i] for i in range(n)}, []
    for i in tree.order.tolist():
        if len(members) == 1:
            break
        near = tree.query(vectors[i], int(sizes[i]), percent)
        for j in near[label[near] != label[i]].tolist():
            if label[j] != label[i] and (linked is None or linked(i, j)):
                out.append((i, j))
                small, large = sorted((label[i], label[j]), key=lambda x: len(members[x]))
                moved = members.pop(small)
                label[moved] = large
                members[large] += moved
    return out


def word_shingles(text: bytes, n: int) -> set[tuple]:
    """The shingles of a text as words, for the last check of a pair."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    return set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else {tuple(words)}  # noqa: B905


def links(sets: list[np.ndarray], percent: int, texts: list[bytes] | None = None, n: int = 0) -> list[int]:
    """A label for each set: equal labels if and only if links connect them.

    Where texts are given, a pair whose hashes reach the threshold is linked only if its words do.
    """
    held: dict[int, set[tuple]] = {}

    def words_of(i: int) -> set[tuple]:
        if i not in held:
            if len(held) > 2:
                held.pop(next(iter(held)))
            held[i] = word_shingles(texts[i], n)
        return held[i]

    def linked(i: int, j: int) -> bool:
        a, b = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
        at = np.searchsorted(b, a)
        both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
        if 100 * both < percent * (len(a) + len(b) - both):
            return False
        if texts is None:
            return True
        a, b = words_of(i), words_of(j)
        both = len(a & b)
        return 100 * both >= percent * (len(a) + len(b) - both)

    dimensions = dimensions_for(max(map(len, sets)))
    while dimensions > DIMENSIONS and dimensions * len(sets) > 1 << 23:
        dimensions //= 2
    vectors = np.stack([count_vector(s, dimensions).astype("i4") for s in sets])
    label = list(range(len(sets)))

    def top(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, j in forest(vectors, np.array([len(s) for s in sets]), percent, linked):
        label[top(i)] = top(j)
    return [top(i) for i in range(len(sets))]


def verified(family_texts: DataFrame, n: int, percent: int, kind: str, key: bytes) -> DataFrame:
    """(set_key, component, group_key): of each family's sets (root, set_key, min_doc, text), sorted by root; group_key is the group's least set_key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held, known = None, {}, WordIds(key)

        def joined() -> pa.RecordBatch:
            keys, docs, sets, texts = zip(*[(k, *v) for k, v in held.items()], strict=True)
            label = links(list(sets), percent, texts, n)
            least: dict[int, object] = {}
            first: dict[int, bytes] = {}
            for g, d, k in zip(label, docs, keys, strict=True):
                if d is not None and (least.get(g) is None or d < least[g]):
                    least[g] = d
                first[g] = min(k, first.get(g, k))
            columns = [pa.array(keys, pa.binary()), pa.array([least.get(g) for g in label], doc_type), pa.array([first[g] for g in label], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["set_key", "component", "group_key"])

        for whole in batches:
            doc_type = whole.schema.field(2).type
            for batch in parts_by_bytes(whole, 3):
                texts = batch.column(3).cast(pa.binary()).to_pylist()
                rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(3), n, known), texts, strict=True)
                for r, name, doc, s, text in rows:
                    if r != root and held:
                        yield joined()
                        held = {}
                    root = r
                    held[name] = (doc, s.copy(), text)
        if held:
            yield joined()

    return family_texts.mapInArrow(run, f"set_key binary, component {kind}, group_key binary")


def one_text_each(rows: DataFrame) -> DataFrame:
    """Rows without those whose set_key a task has had already, so that copies aren't sent on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for k in batch.column(1).to_pylist():
                keep.append(k not in seen)
                seen.add(k)
                if len(seen) > 500_000:
                    seen.clear()
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_md5, group_key) of every row of docs (doc_id, text).

    Rows are of one group if and only if their group_key is equal, ids or not; without shingles it is null.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    total, key = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1, new_key()
    every = stored(shingled(docs.select("doc_id", "text"), n, percent, -(-total // BUCKET), key), "sets")
    sets = every.where("bucket is null")
    vectors = sets.where("vector is not null").groupBy("set_id").agg(F.max("vector").alias("vector"))
    points = shared_keys(every).join(vectors, "set_id").select("key", "set_id", "vector")
    families = components(near_points(points.repartition("key").sortWithinPartitions("key", "set_id"), percent))
    sets = stored(sets.select("doc_id", "n_shingles", "set_key", "set_id", "text_md5"), "classes")
    dropped(every)  # keys and vectors have done their part; families are stored
    classes = sets.where("set_key is not null").groupBy("set_key", "set_id").agg(F.min("doc_id").alias("min_doc"), F.min("text_md5").alias("text_md5"))
    wanted = classes.join(families.withColumnRenamed("node", "set_id"), "set_id").select("root", "set_key", "min_doc", F.col("text_md5").alias("_md5"))
    texts = docs.select("text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_md5"))
    met = one_text_each(texts.join(wanted, "_md5").select("root", "set_key", "min_doc", "text"))
    linked = verified(met.repartition("root").sortWithinPartitions("root", "set_key"), n, percent, kind, key)
    named = classes.join(linked, "set_key", "left").select(F.col("set_key").alias("_key"), F.coalesce("component", "min_doc").alias("component_id"), F.coalesce("group_key", "set_key").alias("group_key"))
    rows = sets.select("doc_id", "n_shingles", "set_key", "text_md5")
    out = rows.join(named, F.col("set_key") == F.col("_key"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_md5", "group_key")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_md5) of every row of docs (doc_id, text)."""
    return jaccard_groups(docs, n, percent).drop("group_key")


def op3_rtree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90).drop("text_md5")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays; documents without shingles all stay.

    It is that with the smallest id (null ids last), of several texts with that id the one with
    the least MD5, of several rows with both equal the one whose columns are least.
    """
    found = jaccard_groups(docs, 5, 80)
    counted = found.groupBy("group_key", "doc_id", "text_md5").agg(F.count(F.lit(1)).alias("n"))
    alone = F.col("group_key").isNull()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5", (~alone & (F.col("n") > 1)).alias("several"))).alias("least")
    chosen = counted.groupBy("group_key", F.when(alone, F.col("doc_id")).alias("id"), F.when(alone, F.col("text_md5")).alias("md5")).agg(least)
    keep = stored(chosen.select(F.col("least.doc_id").alias("__kept_id"), F.col("least.text_md5").alias("__kept_md5"), F.col("least.several").alias("__several")), "keep")
    md5 = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    same = F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (md5 == F.col("__kept_md5"))
    single = docs.join(keep.where("not __several"), same, "left_semi")
    several = docs.join(keep.where("__several"), same, "left_semi")
    one = several.groupBy(F.col("doc_id").alias("__kept_id"), md5.alias("__kept_md5")).agg(F.min(F.struct(*aside(docs))).alias("__row"))
    return single.unionByName(one.select("__row.*").select(*restored(docs)))
