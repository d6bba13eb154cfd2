"""A quality classifier by co-training.

Two views of a document get a classifier each: its content (every word, and every word's
ending of three bytes) and its page metadata (source, language, length). Features are
hashed to BINS bins; a view is a naive Bayes model of the bins a document has. The sum of
its bins' log odds is divided by the root of their number in the text view, as words
don't come independently.

Rounds. Both views first learn from the labelled documents. In each round after that a view
labels documents without a label for the other one: as good those of its highest odds,
as bad those of its lowest, `share` more of all unlabelled documents in each round, in
the proportion of the labels, whole steps of odds at a time. It labels as good only where its
calibrated probability exceeds the share of good labels and as bad only where it is below
one half, so a view that knows nothing teaches nothing wrong. Labels given are made anew in
each round. At last both views' calibrated log odds, less one prior, are added, and every
document is scored.

Calibration: labelled documents with crc32(doc_id) mod 5 = 0 are kept out of the counts; the
share of good ones among them by step of a view's odds, made monotonic by pooling
neighbours, gives its calibrated log odds.

Documents are read once; their bins (a fifth of the text's size) are stored, and every pass
over them is one aggregation with map-side combining, in which neither hot sources nor
copies meet. What reaches the driver is bounded: counts by bin (BINS a view) and by step.

Null texts are empty: without bins their text odds are 0. Null metadata has bins of its own.
Very long texts are read as a whole by one task. Of several labels of one id the larger
counts. Rows with equal ids are rows of their own. Without labels every score is 0.5. An
empty table gives no rows. Other columns are not read; toxic isn't used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import stored, table
from strandline.llm.hashing import mix, parts_by_bytes, range_hashes, text_bytes, word_spans

ROUNDS, SHARE, BINS, STEPS, PER_UNIT = 3, 0.1, 1 << 16, 256, 2
LENGTHS = (50, 150, 400, 1000, 3000, 10000)


class View(NamedTuple):
    """A trained view: weights by bin, calibrated log odds by step, and from which steps on it labels as good, up to which as bad."""

    weights: np.ndarray
    calibrated: np.ndarray
    good_from: int
    bad_to: int


def text_bins(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct bins of each text: its words and their endings."""
    data, offsets = text_bytes(column)
    starts, stops, first = word_spans(data, offsets)
    with np.errstate(over="ignore"):
        word = range_hashes(data, starts, stops)
        ending = mix(range_hashes(data, np.maximum(starts, stops - 3), stops) + np.uint64(1))
    both = (np.stack([word, ending]) >> np.uint64(48)).astype("<u2")
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(both[:, a:b])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_bins, meta_bins) of documents, bins as packed 16-bit numbers."""
    def name(c: str):
        return F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(c), c), F.lit(BINS))).cast("int")

    length = F.when(F.col("n_chars").isNull(), F.lit(-1)).otherwise(sum(((F.col("n_chars") > e).cast("int") for e in LENGTHS), F.lit(0)))
    rows = docs.select("doc_id", "text", name("source").alias("source"), name("lang").alias("lang"), F.pmod(F.xxhash64(F.lit("length"), length), F.lit(BINS)).cast("int").alias("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts_by_bytes(whole, 1):
                meta = np.stack([batch.column(c).to_numpy() for c in (2, 3, 4)], 1).astype("<u2")
                columns = [batch.column(0), pa.array([b.tobytes() for b in text_bins(batch.column(1))], pa.binary()), pa.array([m.tobytes() for m in meta], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_bins", "meta_bins"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_bins binary, meta_bins binary")


def bins_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bins of all rows, joined, and each row's first among them."""
    data, offsets = text_bytes(column)
    return data.view("<u2") if len(data) else np.empty(0, "<u2"), offsets // 2


def odds(bins: np.ndarray, offsets: np.ndarray, weights: np.ndarray, rooted: bool) -> np.ndarray:
    number = np.diff(offsets)
    total = np.bincount(np.repeat(np.arange(len(number)), number), weights[bins], len(number))
    return total / np.sqrt(np.maximum(number, 1)) if rooted else total


def step_of(log_odds: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(log_odds * PER_UNIT).astype("i8") + STEPS // 2, 0, STEPS - 1)


def steps_of(batch: pa.RecordBatch, views: list[View]) -> list[np.ndarray]:
    """The step of every row's odds in both views."""
    return [step_of(odds(*bins_of(batch.column(c)), view.weights, not c)) for c, view in enumerate(views)]


def weights_of(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Log odds of every bin, with one half added to each count; bins that no taught document has weigh nothing."""
    w = np.log((good + 0.5) / (n_good + 1)) - np.log((bad + 0.5) / (n_bad + 1))
    return np.where(bad + good > 0, w, 0.0)


def monotonic(bad: np.ndarray, good: np.ndarray, prior: float, weight: float = 0.05) -> np.ndarray:
    """Calibrated log odds of every step, by pooling neighbours that fall; each step has a little of the prior."""
    pools: list[list[float]] = []  # good, all, steps
    for b, g in zip(bad.tolist(), good.tolist(), strict=True):
        pools.append([g + weight * prior, b + g + weight, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    p = np.clip(np.repeat([g / n for g, n, _ in pools], [int(k) for *_, k in pools]), 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def reach(open_: np.ndarray, calibrated: np.ndarray, share: float, prior: float) -> tuple[int, int]:
    """The steps from which a view labels as good and up to which as bad, open_ being the unlabelled documents by step."""
    good_from, bad_to, centre = STEPS, -1, math.log(prior / (1 - prior))
    left = share * prior * open_.sum()
    while left > 0 and good_from > 0 and calibrated[good_from - 1] > centre:
        good_from -= 1
        left -= open_[good_from]
    left = share * (1 - prior) * open_.sum()
    while left > 0 and bad_to + 1 < good_from and calibrated[bad_to + 1] < 0:
        bad_to += 1
        left -= open_[bad_to]
    return good_from, bad_to


TALLY = "view int, cell int, bad bigint, good bigint, open bigint"


def tallied(rows: DataFrame, run) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each view the sums (bad, good, open) by cell of what run(batch) adds to a task's counts; cell BINS holds the rows' number."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 3, BINS + 1), "i8")
        for batch in batches:
            run(batch, held)
        for view in range(2):
            cells = np.flatnonzero(held[view].any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), view, "i4")), pa.array(cells.astype("i4")), *[pa.array(held[view, k, cells]) for k in range(3)]], names=["view", "cell", "bad", "good", "open"])

    found = rows.mapInArrow(task, TALLY).groupBy("view", "cell").agg(*[F.sum(c).alias(c) for c in ("bad", "good", "open")]).toArrow()
    out = np.zeros((2, 3, BINS + 1), "i8")
    view, cell = found["view"].to_numpy(), found["cell"].to_numpy()
    for k, c in enumerate(("bad", "good", "open")):
        out[view, k, cell] = found[c].to_numpy()
    return [tuple(out[v]) for v in range(2)]


def given_labels(batch: pa.RecordBatch, views: list[View] | None) -> list[np.ndarray]:
    """What each view learns from: 1 good, 0 bad, -1 nothing; documents without a label get the other view's."""
    y, held = batch.column(2).fill_null(-1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
    known = np.where(held, -1, y)
    if views is None:
        return [known, known]
    said = [np.where(s >= v.good_from, 1, np.where(s <= v.bad_to, 0, -1)) for s, v in zip(steps_of(batch, views), views, strict=True)]
    return [np.where(y >= 0, known, other) for other in reversed(said)]


def trained(rows: DataFrame, prior: float, rounds: int = ROUNDS, share: float = SHARE) -> tuple[list[View], list[list[tuple[int, int]]]]:
    """Both views after all rounds, and how many (bad, good) documents each of them learned from in each round."""
    spark, views, taught = rows.sparkSession, None, []
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(views)

        def learn(batch: pa.RecordBatch, held: np.ndarray) -> None:
            for v, label in enumerate(given_labels(batch, sent.value)):  # noqa: B023
                bins, offsets = bins_of(batch.column(v))
                for c in range(2):
                    held[v, c, :BINS] += np.bincount(bins[np.repeat(label == c, np.diff(offsets))], minlength=BINS)
                    held[v, c, BINS] += np.count_nonzero(label == c)

        counts = tallied(rows, learn)
        taught.append([(int(bad[BINS]), int(good[BINS])) for bad, good, _ in counts])
        models = [View(weights_of(bad[:BINS], good[:BINS], bad[BINS], good[BINS]), np.zeros(STEPS), STEPS, -1) for bad, good, _ in counts]
        tested = spark.sparkContext.broadcast(models)

        def test(batch: pa.RecordBatch, held: np.ndarray) -> None:
            y, out = batch.column(2).fill_null(-1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            for v, step in enumerate(steps_of(batch, tested.value)):  # noqa: B023
                for k, those in enumerate((out & (y == 0), out & (y == 1), y < 0)):
                    held[v, k, :STEPS] += np.bincount(step[those], minlength=STEPS)

        views = []
        for model, (bad, good, open_) in zip(models, tallied(rows, test), strict=True):
            calibrated = monotonic(bad[:STEPS], good[:STEPS], prior)
            views.append(View(model.weights, calibrated, *reach(open_[:STEPS], calibrated, share * (turn + 1), prior)))
        sent.destroy()
        tested.destroy()
    return views, taught


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text_bins, meta_bins, y, held, doc_id) of all documents.

    The join is a merge join at every size: labels grow with the corpus, so broadcasting them is no plan.
    """
    truth = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")).withColumnRenamed("doc_id", "_doc").hint("merge")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    rows = features(docs).join(truth, F.col("doc_id") == F.col("_doc"), "left")
    return rows.select("text_bins", "meta_bins", "y", held.alias("held"), "doc_id")


def prior_of(rows: DataFrame) -> float:
    good, known = rows.where("y is not null").agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("y")).first()
    return (good + 1) / (known + 2)


def scored(rows: DataFrame, views: list[View], prior: float) -> DataFrame:
    """(doc_id, text_odds, meta_odds, score, kept) of all rows by two trained views."""
    sent, centre = rows.sparkSession.sparkContext.broadcast(views), math.log(prior / (1 - prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = (v.calibrated[s] for v, s in zip(sent.value, steps_of(batch, sent.value), strict=True))
            score = 1 / (1 + np.exp(-(text + meta - centre)))
            yield pa.RecordBatch.from_arrays([batch.column(4), *map(pa.array, (text, meta, score, score >= 0.5))], names=["doc_id", "text_odds", "meta_odds", "score", "kept"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_odds double, meta_odds double, score double, kept boolean")


def cotrain(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """(doc_id, text_odds, meta_odds, score, kept): calibrated log odds of both views and the probability of good quality."""
    rows = stored(labelled(docs, labels), "features")
    prior = prior_of(rows)
    views, _ = trained(rows, prior, rounds, share)
    return scored(rows, views, prior)


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
