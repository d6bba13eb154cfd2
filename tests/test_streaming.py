"""Streaming contexts and sessions against batch ones: late and repeated ticks, restarts, time-to-live."""

import datetime as dt
import random
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from strandline.operators.context import contexts
from strandline.sources import bars
from strandline.streaming.bars import stream_bars
from strandline.streaming.contexts import stream_contexts

D = dt.datetime
TICKS = "k string, ts timestamp_ntz, v double, o bigint"


def ticks(n=400, seed=2):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 4 + ["b", "c"]), D(2024, 1, 1) + dt.timedelta(minutes=4 * i + rng.randrange(4)), rng.choice([rng.random() * 10] * 9 + [None]), i) for i in range(n)]


def write(spark, rows, src):
    spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(src)


def run(df, out, checkpoint):
    q = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_until(df, out, checkpoint, n):
    """Runs a query that doesn't end by itself until it has written n rows."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    for _ in range(60):
        time.sleep(0.5)
        try:
            if df.sparkSession.read.schema(df.schema).parquet(out).count() >= n:
                break
        except AnalysisException:
            pass
    q.stop()


def plain(rows):
    return sorted((r.ticker, r.last_ts, r.n_raw, r.n_padded, [pytest.approx(x) for x in r.context]) for r in rows)


def closed_contexts(spark, rows, until, n):
    """The contexts after each hourly bar that ends at or before `until`."""
    series = bars.resample(spark.createDataFrame(rows, TICKS), "k", "ts", "v", "o", "1h").select("ticker", "ts", F.col("close").alias("value"))
    out = []
    for stamp in sorted({r.ts for r in series.select("ts").distinct().collect()}):
        if stamp + dt.timedelta(hours=1) <= until:
            at = F.lit(str(stamp)).cast("timestamp_ntz")
            out += contexts(series.where(F.col("ts") <= at), n).where(F.col("last_ts") == at).collect()
    return out


def test_replay_late_repeated_and_restart(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = ticks()
    half = rows[:200]
    write(spark, half + half[150:200], src)  # repeated within one file
    stream = lambda: stream_contexts(stream_bars(spark.readStream.schema(TICKS).parquet(src), "k", "ts", "v", "1h", order="o", unique="o").select("ticker", "ts", F.col("close").alias("value")), 32, ttl=None)
    run(stream(), out, cp)
    first = spark.read.parquet(out).count()
    assert first > 5
    late = ("hot", D(2024, 1, 1), 99.0, 9999)  # its bar was closed long ago
    write(spark, [*rows[200:], late, *rows[195:200]], src)
    run(stream(), out, cp)  # restarted: state and watermark come from the checkpoint
    got = spark.read.parquet(out).collect()
    want = closed_contexts(spark, rows, rows[-1][1] - dt.timedelta(hours=1), 32)
    assert plain(got) == plain(want) and len(got) > first
    assert len({(r.ticker, r.last_ts) for r in got}) == len(got)


def test_missing_values_and_order(spark, tmp_path):
    src, nan = str(tmp_path / "src"), float("nan")
    rows = [("A", D(2024, 1, d), v, 0) for d, v in ((3, 4.0), (1, nan), (2, 2.0), (4, None), (4, None), (5, float("inf")))] + [("none", D(2024, 1, 1), None, 0), (None, D(2024, 1, 1), 1.0, 0)]
    write(spark, rows, src)
    series = spark.readStream.schema(TICKS).parquet(src).select(F.col("k").alias("ticker"), "ts", F.col("v").alias("value"))
    run(stream_contexts(series, 32, ttl=None), str(tmp_path / "mean"), str(tmp_path / "cp1"))
    got = {r.last_ts.day: r.context[-r.n_raw :] for r in spark.read.parquet(str(tmp_path / "mean")).collect()}
    assert got == {2: [2.0, 2.0], 3: [3.0, 2.0, 4.0], 4: [3.0, 2.0, 4.0, 3.0], 5: [3.0, 2.0, 4.0, 3.0, 3.0]}
    run(stream_contexts(series, 32, "none", None), str(tmp_path / "none"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 6
    with pytest.raises(ValueError, match="impute"):
        stream_contexts(series, 32, "zero")


def test_state_ends_after_its_time_to_live(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    series = lambda: spark.readStream.schema(TICKS).parquet(src).select(F.col("k").alias("ticker"), "ts", F.col("v").alias("value"))
    write(spark, [("A", D(2024, 1, d), float(d), 0) for d in (1, 2)], src)
    run_until(stream_contexts(series(), 32, ttl="2 seconds"), out, cp, 2)
    time.sleep(3)
    write(spark, [("A", D(2024, 1, 3), 3.0, 0)], src)
    run_until(stream_contexts(series(), 32, ttl="2 seconds"), out, cp, 3)
    assert {r.last_ts.day: r.n_raw for r in spark.read.parquet(out).collect()} == {1: 1, 2: 2, 3: 1}
