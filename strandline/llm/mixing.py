"""Mixing sources to target weights by hash thresholds.

A document's words are its size. Its hash is fixed by its id (by its text where the id is
null), so reruns and larger budgets agree: a source's share takes every document some whole
number of times, and once more those whose hash lies below the source's threshold. The
threshold comes from histograms of words by source and hash bucket (12 bits a level): the
boundary bucket of one level is the only one that the next level counts, so no document is
ever sorted. After three levels the boundary is one 36-bit hash; it is taken if that
brings the source nearer to its target.

Sources may be as hot as they like: histograms are summed before they are shuffled and
have 4096 rows a source at most, and documents meet the thresholds in a join salted by
their hash. The targets need one row per source in one window.

Null texts have size 0 and are never taken; a null source is a source of its own (the
last); rows with equal ids get equal hashes and go together; very long texts only have larger
sizes; an empty table gives an empty result. Columns of the input that have the operator's
names are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import aside, n_words, restored, stored, table

LEVELS, BITS, SALTS = 3, 12, 16


def hash36(doc_id: Column, text: Column) -> Column:
    """The first 36 bits of the MD5 of the id as text, or of the text where there is no id."""
    key = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 9), 16, 10).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"size": n_words(F.col("text")), "_h": hash36(F.col("doc_id"), F.col("text"))})


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, target): sources in order of code points get the weights in turn.

    Together the targets are all words. A target stops at cap times its source's size and the
    excess goes to the others by weight: in order of size to weight the capped ones come first.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.array(*[F.lit(x) for x in weights])[turn % len(weights)]
    by_ratio = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    limit = F.col("source_size") * cap
    ranked = totals.withColumn("_w", w).withColumns({
        "_before": F.coalesce(F.sum(limit).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_rest": F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        "_all": F.sum("source_size").over(everything),
    })
    capped = ranked.withColumn("_capped", limit.cast("double") * F.col("_rest") <= F.col("_w").cast("double") * (F.col("_all") - F.col("_before")))
    shared = capped.withColumns({
        "_r": F.col("_all") - F.coalesce(F.sum(F.when(F.col("_capped"), limit)).over(everything), F.lit(0)),
        "_wr": F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(everything),
    })
    target = F.when(F.col("_capped"), limit.cast("double")).otherwise(F.col("_w").cast("double") * F.col("_r") / F.col("_wr"))
    return shared.select("source", "source_size", target.alias("target"))


def salted_join(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of their source's one row; each source's rows are dealt to SALTS keys."""
    right = by_source.withColumnRenamed("source", "_source").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("_s", (F.col("_h") % SALTS).cast("int"))
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_s") == F.col("_salt")), how).drop("_source", "_salt", "_s")


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, cut): take all documents `copies` times and those with _h < cut once more."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    state = budgets.withColumns({"copies": copies, "cut": F.lit(0).cast("bigint"), "_below": F.lit(0).cast("bigint"), "_last": F.lit(0).cast("bigint")})
    state = stored(state.withColumn("_budget", F.col("target") - F.col("copies") * F.col("source_size")), "mix-state")
    rows = sizes.select("source", "size", "_h")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        if level:
            edge = state.select("source", F.col("cut").alias("_cut"))
            rows = salted_join(rows, edge).where(F.shiftright("_h", shift + BITS) == F.shiftright("_cut", shift + BITS)).drop("_cut")
        hist = rows.groupBy("source", F.shiftright("_h", shift).alias("_b")).agg(F.sum("size").alias("_n"))
        running = hist.withColumn("_sum", F.sum("_n").over(Window.partitionBy("source").orderBy("_b")))
        over = state.select(F.col("source").alias("_source"), (F.col("_budget") - F.col("_below")).alias("_left"))
        found = running.join(over, F.col("source").eqNullSafe(F.col("_source"))).where(F.col("_sum") > F.col("_left"))
        first = found.groupBy("source").agg(F.min_by(F.struct("_b", "_n", "_sum"), "_b").alias("_f"))
        first = first.select(F.col("source").alias("_source"), F.shiftleft("_f._b", shift).alias("_to"), (F.col("_f._sum") - F.col("_f._n")).alias("_add"), F.col("_f._n").alias("_size"))
        after = state.join(first, F.col("source").eqNullSafe(F.col("_source")), "left").withColumns({
            "cut": F.coalesce("_to", "cut"), "_below": F.col("_below") + F.coalesce("_add", F.lit(0)), "_last": F.coalesce("_size", F.lit(0)),
        }).drop("_source", "_to", "_add", "_size")
        state = stored(after, "mix-state")
    nearer = (F.col("_last") > 0) & (F.col("_below") + F.col("_last") - F.col("_budget") < F.col("_budget") - F.col("_below"))
    return state.select("source", "source_size", "target", "copies", (F.col("cut") + nearer.cast("bigint")).alias("cut"))


MIXED = ("size", "source_size", "target", "times")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default), and size, source_size, target and times: how often the mix takes the document."""
    keep = [c for c in docs.columns if c not in MIXED] if keep is None else keep
    own = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    rows = stored(sized(docs.select("doc_id", "text", "source", *own)).drop("doc_id", "text"), "mix-sizes")  # words are counted once
    found = thresholds(rows, targets(rows, weights, cap))
    times = F.when(F.col("size") > 0, F.col("copies") + (F.col("_h") < F.col("cut")).cast("bigint")).otherwise(0)
    return salted_join(rows, found).select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", times.alias("times"))


def op10_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: documents taken twice or three times stand there as often."""
    taken = mixed(docs.select("doc_id", "text", "source", *aside(docs)), keep=[f"__c{i}" for i in range(len(docs.columns))])
    again = F.when(F.col("times") > 0, F.sequence(F.lit(1), F.col("times").cast("int"))).otherwise(F.array())
    return taken.withColumn("_i", F.explode(again)).select(*restored(docs))


_KEY = "coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))"
MIX_SQL = """s AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size,
    ('0x' || substr(md5(@key), 1, 9))::BIGINT AS h FROM @docs),
  tot AS (SELECT source, sum(size)::BIGINT AS source_size, (ARRAY[5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s GROUP BY source),
  rk AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS al FROM tot),
  cp AS (SELECT *, (3 * source_size)::DOUBLE * rest::DOUBLE <= w::DOUBLE * (al - bef)::DOUBLE AS capped FROM rk),
  tg AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE w::DOUBLE * (al - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0))::DOUBLE / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM cp),
  bg AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM tg),
  hs AS (SELECT source, h, sum(size)::BIGINT AS n FROM s GROUP BY ALL),
  rn AS (SELECT hs.*, sum(n) OVER (PARTITION BY source ORDER BY h)::BIGINT AS cum FROM hs),
  ed AS (SELECT rn.source, arg_min(h, h) AS h0, arg_min(cum - n, h) AS below, arg_min(n, h) AS last, any_value(target - copies * source_size) AS budget
    FROM rn JOIN bg ON rn.source IS NOT DISTINCT FROM bg.source WHERE cum > target - copies * source_size GROUP BY 1),
  ct AS (SELECT source, h0 + CASE WHEN last > 0 AND below + last - budget < budget - below THEN 1 ELSE 0 END AS cut FROM ed),
  mix AS (SELECT s.*, source_size, target, CASE WHEN size > 0 THEN copies + CASE WHEN h < cut THEN 1 ELSE 0 END ELSE 0 END AS times
    FROM s JOIN bg ON s.source IS NOT DISTINCT FROM bg.source LEFT JOIN ct ON s.source IS NOT DISTINCT FROM ct.source)"""

SQL = f"WITH {MIX_SQL.replace('@key', _KEY).replace('@docs', 'documents')} SELECT doc_id, size, source_size, target, size * times AS taken FROM mix"
