"""Bars of a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.config import INTERVALS, one_of

# Window lengths; windows count from 1970-01-01, a Thursday, and weeks begin on Monday.
LENGTHS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour", "1d": "1 day", "1wk": "7 days"}
TO_MONDAY = "4 days"


def stream_bars(ticks: DataFrame, ticker: str, ts: str, value: str, interval: str = "1h", late: str = "1 hour", order: str | None = None, unique: str | None = None) -> DataFrame:
    """OHLCV bars, those of `resample`; a bar is final once the watermark passes its end, later ticks are dropped.

    order breaks ties of ts for open and close. unique names a tick's id: a tick that comes again within the
    watermark isn't counted again. Months have no fixed length, so a stream has no monthly bars.
    """
    if one_of("interval", interval, INTERVALS) == "1mo":
        raise ValueError("a stream has no monthly bars: resample its daily ones")
    rows = ticks.where(F.col(ticker).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull())
    # windows and watermarks take instants only: clock times are read as UTC, so that the session's zone moves no bar
    timed = rows.withColumn("_at", F.to_timestamp(F.concat(F.col(ts).cast("timestamp_ntz").cast("string"), F.lit("Z")))).withWatermark("_at", late)
    timed = timed.dropDuplicatesWithinWatermark([unique]) if unique else timed
    window = F.window("_at", LENGTHS[interval], startTime=TO_MONDAY if interval == "1wk" else "0 seconds")
    at = F.struct("_at", order) if order else F.col("_at")
    bars = timed.groupBy(F.col(ticker).alias("ticker"), window).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(F.lit(1)).alias("volume")
    )
    start = F.expr("timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, unix_seconds(window.start))")
    return bars.select("ticker", start.alias("ts"), "open", "high", "low", "close", "volume")
