"""Session bars: ticks of a ticker that follow each other within a gap are one bar, in batch and in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_bars(ticks: DataFrame, ticker: str, ts: str, value: str, order: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(ticker, ts, last_ts, open, high, low, close, volume, volume_value) of sessions: first and last tick, OHLC, ticks and their sum.

    A tick that comes more than the gap after the one before starts a session. order breaks ties of ts. Rows without
    ticker, ts or value are left out. late: for a stream, how long ticks may come after later ones; a session is
    final once the watermark has passed its last tick by the gap. Spark merges the sessions of partial
    rows before and after the shuffle; all clock times are read as UTC, so no zone moves a session.
    """
    rows = ticks.where(F.col(ticker).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull())
    local = F.col(ts).cast("timestamp_ntz")
    timed = rows.select(F.col(ticker).alias("ticker"), local.alias("_ts"), F.to_timestamp(F.concat(local.cast("string"), F.lit("Z"))).alias("_at"), F.col(value).alias("_v"), F.col(order).alias("_o"))
    if late is not None:
        timed = timed.withWatermark("_at", late)
    at = F.struct("_ts", "_o")
    made = timed.groupBy("ticker", F.session_window("_at", gap)).agg(
        F.min("_ts").alias("ts"), F.max("_ts").alias("last_ts"), F.min_by("_v", at).alias("open"), F.max("_v").alias("high"), F.min("_v").alias("low"), F.max_by("_v", at).alias("close"),
        F.count(F.lit(1)).alias("volume"), F.sum("_v").alias("volume_value"),
    )
    return made.drop("session_window")
