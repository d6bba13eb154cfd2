"""Source divergence audit by systolic rotation.

For each language the terms in at least LEAST of its documents are kept. Every (lang, source)
group and every language as a whole gives each kept term the smoothed share

    p = 1 + floor(10**9 * (count + PRIOR) / (N + PRIOR * V)),  N: the group's kept occurrences,

and groups of a language are compared by sums of |p - q| over all of its kept terms.

1. Tasks count terms by group as they read and send sums; only terms and groups are shuffled.
2. A language's kept terms are dealt by hash to shards of about SHARD terms, and its groups to blocks of
   about BLOCK. A group's counts in one shard are one compressed vector of its nonzero terms.
3. Blocks are the players of a round-robin tournament (the circle method). A block's vectors stay in
   its task; in every round it is either visited by the one block that it meets or visits that.
   A task takes its residents first and its visitors in order of rounds, one at a
   time, so it holds one block, one shard's terms and one visitor, whatever the number of
   groups. A meeting is evaluated once and counts in both directions.
4. A resident's terms are ranked by a heap of the `top` largest in each shard; the heaps of
   shards are merged by one ranking.

Sums over shards are exact whole numbers added up. A hot group is as many vectors as the
language has shards, each no longer than a shard's terms. The pairs of a language are as many as the
result needs; nothing else grows with their square.

Null text, lang and source are read as ''. Groups without terms, and languages without kept
terms, are compared as well (values of 0). Repeated rows are documents of their own. Very long texts
are counted whole in their task. Ties rank by the item's UTF-8 bytes. Columns other than text, lang
and source are not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import stored, table
from strandline.llm.hashing import grown, shrink

LEAST, PRIOR, SCALE_STEPS, TOP = 30, 5, 3, 50
SHARD, BLOCK = 8192, 8
#: Counts that a task holds before it sends them on.
HELD = 200_000

#: Letters stay (capitals become small ones), bytes of other characters too; all others separate terms.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term; a row with a null term for each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def sent() -> pa.RecordBatch:
            rows: list[list] = [[], [], [], [], []]
            for (lang, source), (occurrences, documents) in groups.items():
                k = len(occurrences) + 1
                for column, values in zip(rows, ([lang] * k, [source] * k, [None, *(t.decode() for t in occurrences)], [0, *occurrences.values()], [0, *(documents[t] for t in occurrences)]), strict=True):
                    column += values
            groups.clear()
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for text, lang, source in zip(*(batch.column(i) for i in range(3)), strict=True):
                occurrences, documents = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before = len(occurrences)
                found = Counter(terms_of(text.as_py()))
                occurrences.update(found)
                documents.update(found.keys())
                held += len(occurrences) - before
                if held > HELD:
                    yield sent()
                    held = 0
        if groups:
            yield sent()

    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    sums = read.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of each count: 1 + floor(10**9 * (count + PRIOR) / (total + PRIOR * terms)), by long division in steps of a thousand."""
    whole, rest, out = max(1, total + PRIOR * terms), counts + PRIOR, np.zeros(len(counts), "i8")
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


class Vector:
    """A group's shares in a shard: those of its nonzero terms, and the one of all others."""

    def __init__(self, source: str, total: int, packed: bytes, width: int, terms: int):
        both = grown(packed, "i8").reshape(2, -1)
        self.source, self.at, self.counts, self.width = source, both[0], both[1], width
        self.p, self.rest = shares(self.counts, total, terms), int(shares(np.zeros(1, "i8"), total, terms)[0])
        self.ordered = None

    def dense(self) -> np.ndarray:
        out = np.full(self.width, self.rest, "i8")
        out[self.at] = self.p
        return out

    def from_level(self, level: int) -> int:
        """The sum of |p - level| over all terms of the shard."""
        if self.ordered is None:
            self.ordered = np.sort(self.p)
            self.sums = np.concatenate([[0], np.cumsum(self.ordered)])
        k, n = int(np.searchsorted(self.ordered, level)), len(self.ordered)
        below, above = level * k - int(self.sums[k]), int(self.sums[n] - self.sums[k]) - level * (n - k)
        return below + above + (self.width - n) * abs(self.rest - level)


def distance(home: Vector, dense: np.ndarray, visitor: Vector) -> int:
    """The sum of |p - q| of two groups over all terms of a shard, at the cost of the visitor's nonzero terms."""
    p = dense[visitor.at]
    return home.from_level(visitor.rest) + int(np.abs(p - visitor.p).sum() - np.abs(p - visitor.rest).sum())


def pack_vector(pairs: Column) -> Column:
    """The vector of array<struct<at, n>> as compressed binary."""
    @F.arrow_udf("binary")
    def pack(column: pa.Array) -> pa.Array:
        rows = []
        for row in column:
            values = row.values.flatten()
            at, n = (np.asarray(v.to_numpy(zero_copy_only=False), "i8") for v in values)
            order = np.argsort(at)
            rows.append(shrink(np.stack([at[order], n[order]])))
        return pa.array(rows, pa.binary())

    return pack(pairs)


def schedule(players: Column, me: Column) -> Column:
    """The rounds in which block `me` travels, as array<struct<round, host>>; the circle method over players blocks.

    With an even number of seats, seat s - 1 stands still and seats i and j < s - 1 meet in the round
    (i + j) modulo (s - 1). Of two that meet, the one with the smaller number travels if their sum is even.
    """
    seats = players + players % 2
    rounds = F.sequence(F.lit(0).cast("bigint"), F.greatest(seats - 2, F.lit(0)))

    def meeting(r: Column) -> Column:
        turn = F.greatest(seats - 1, F.lit(1))
        still = F.pmod(r * ((turn + 1) / 2).cast("bigint"), turn)
        opponent = F.pmod(r - me, turn)
        host = F.when(me == seats - 1, still).when(opponent == me, seats - 1).otherwise(opponent)
        return F.struct(r.alias("round"), host.alias("host"))

    def travels(x: Column) -> Column:
        even = F.pmod(x["host"] + me, F.lit(2)) == 0
        return (x["host"] < players) & (x["host"] != me) & F.when(even, me < x["host"]).otherwise(me > x["host"])

    return F.filter(F.transform(rounds, meeting), travels)


FOUND = "lang string, source string, part string, item string, value bigint"


def tournament(rows: DataFrame, top: int) -> DataFrame:
    """FOUND of rows (lang, shard, block, round, source, total, terms, packed, words), dealt and sorted by their first five columns.

    Round -2 brings the shard's terms with the language's counts, -1 a resident, all others visitors.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, whole, width = None, [], None, 0
        homes: list[tuple[Vector, np.ndarray]] = []
        out: list[tuple] = []
        for batch in batches:
            for lang, shard, block, turn, source, total, terms, packed, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, shard, block) != now:
                    now, words, width, homes = (lang, shard, block), [], 0, []
                if turn == -2:
                    words, width = names, len(names)
                    whole = Vector("", total, packed, width, terms).dense()
                    continue
                vector = Vector(source, total, packed, width, terms)
                for home, dense in homes:
                    value = distance(home, dense, vector)
                    out += [(lang, home.source, "pair", source, value), (lang, source, "pair", home.source, value)]
                if turn == -1:
                    homes.append((vector, vector.dense()))
                    over = vector.p - whole[vector.at]
                    for value, at in heapq.nsmallest(top, ((-v, a) for v, a in zip(over.tolist(), vector.at.tolist(), strict=True) if v > 0)):
                        out.append((lang, source, "term", words[at], -value))
                if len(out) >= 10_000:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    def made(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["lang", "source", "part", "item", "value"])

    return rows.mapInArrow(run, FOUND)


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups of docs (text, lang, source)."""
    counts = stored(term_counts(docs), "terms")
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least).select("lang", "term", "n")
    terms = stored(terms, "kept")
    groups = counts.where("term IS NULL").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total")), "lang", "left")
    langs = langs.select(
        "lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total"),
        F.greatest(F.lit(1), F.ceil(F.col("terms") / shard)).cast("bigint").alias("shards"), F.ceil(F.col("sources") / block).cast("bigint").alias("blocks"),
    )
    langs = stored(langs.fillna(1, ["shards"]), "langs")

    in_shard = Window.partitionBy("lang", "shard").orderBy("term")
    placed = terms.join(langs.select("lang", "shards"), "lang").select("lang", "term", "n", F.pmod(F.xxhash64("term"), "shards").alias("shard"))
    placed = stored(placed.withColumn("at", F.row_number().over(in_shard).cast("bigint") - 1), "placed")
    books = placed.groupBy("lang", "shard").agg(F.array_sort(F.collect_list(F.struct("at", "n", "term"))).alias("_all"))
    books = books.select("lang", "shard", F.transform("_all", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"))).alias("_pairs"), F.col("_all.term").alias("words"))

    kept = counts.where("term IS NOT NULL").select("lang", "source", "term", F.col("n").alias("_n")).join(placed.select("lang", "term", "shard", "at"), ["lang", "term"])
    vectors = kept.groupBy("lang", "source", "shard").agg(F.collect_list(F.struct("at", F.col("_n").alias("n"))).alias("_pairs"), F.sum("_n").alias("_total"))
    vectors = stored(vectors, "vectors")
    totals = vectors.groupBy("lang", "source").agg(F.sum("_total").alias("total"))
    every = groups.join(langs.drop("total"), "lang").join(totals, ["lang", "source"], "left").withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    every = every.select("lang", "source", "terms", "blocks", "block", F.coalesce("total", F.lit(0)).alias("total"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"))
    none = F.array().cast("array<struct<at:bigint,n:bigint>>")
    rows = every.join(vectors.drop("_total"), ["lang", "source", "shard"], "left").select("lang", "shard", "source", "block", "blocks", "total", "terms", pack_vector(F.coalesce("_pairs", none)).alias("packed"))
    rows = stored(rows, "packed")

    nothing = F.lit(None).cast("array<string>").alias("words")
    players = F.col("blocks")
    resident = rows.select("lang", "shard", "block", F.lit(-1).cast("bigint").alias("round"), "source", "total", "terms", "packed", nothing)
    visits = rows.withColumn("_meets", F.explode(schedule(players, F.col("block"))))
    visits = visits.select("lang", "shard", F.col("_meets.host").alias("block"), F.col("_meets.round").alias("round"), "source", "total", "terms", "packed", nothing)
    told = langs.select("lang", "terms", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"), F.col("blocks")).join(books, ["lang", "shard"], "left")
    told = told.select(
        "lang", "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.lit(-2).cast("bigint").alias("round"), F.lit("").alias("source"), "total", "terms",
        pack_vector(F.coalesce("_pairs", none)).alias("packed"), F.coalesce("words", F.array().cast("array<string>")).alias("words"),
    )
    dealt = told.unionByName(resident).unionByName(visits).repartition("lang", "shard", "block").sortWithinPartitions("lang", "shard", "block", "round", "source")
    found = stored(tournament(dealt, top), "found")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranking = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(ranking))
    return ranked(pairs).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= top))


def op11_systolic_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
  tokens AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
  terms AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY 1, 2 HAVING count(DISTINCT d) >= 30),
  langs AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN terms USING (lang) GROUP BY 1),
  groups AS (SELECT DISTINCT lang, source FROM docs),
  found AS (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY 1, 2, 3),
  cells AS (SELECT g.lang, g.source, t.term, t.n AS whole, coalesce(f.n, 0) AS n FROM groups g JOIN terms t ON g.lang = t.lang LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = t.term),
  totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY 1, 2),
  shares AS (SELECT c.lang, c.source, c.term, c.n, 1 + 1000000000::HUGEINT * (c.n + 5) // (t.total + 5 * l.v) AS p, 1 + 1000000000::HUGEINT * (c.whole + 5) // (l.total + 5 * l.v) AS q
    FROM cells c JOIN totals t ON t.lang = c.lang AND t.source = c.source JOIN langs l ON l.lang = c.lang),
  pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
  every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 50
"""
