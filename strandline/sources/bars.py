"""Bars (ticker, ts, open, high, low, close, volume) from raw rows, and range selection.

A bar needs one aggregation; Spark combines partial bars before the shuffle, so a
ticker with many ticks costs one row per bar and task.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import INTERVALS, PERIODS, one_of

# Look-back periods as months.
PERIOD_MONTHS = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "2y": 24, "5y": 60}


def bar_start(ts: Column, interval: str) -> Column:
    """Start of the bar that holds ts, as TIMESTAMP_NTZ; weeks begin on Monday, months on the 1st.

    Only dates and clock times of ts itself are used, so the session's time zone changes nothing
    (a TIMESTAMP column is read in it first).
    """
    local = ts.cast("timestamp_ntz")
    day = F.to_date(local)
    if interval in ("1wk", "1mo"):
        return F.trunc(day, "week" if interval == "1wk" else "month").cast("timestamp_ntz")
    midnight = day.cast("timestamp_ntz")
    if one_of("interval", interval, INTERVALS) == "1d":
        return midnight
    minutes = F.hour(local) * 60 + F.minute(local)
    step = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60}[interval]
    return midnight + F.make_dt_interval(mins=(minutes - minutes % step))


def resample(ticks: DataFrame, ticker: str, ts: str, value: str, order: str, interval: str = "1d") -> DataFrame:
    """OHLCV bars of ticks; `order` breaks ties of ts for open and close, volume counts ticks.

    Rows without ticker, ts or value make no bar.
    """
    at = F.struct(F.col(ts), F.col(order))
    rows = ticks.where(F.col(ticker).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(F.col(ticker).alias("ticker"), bar_start(F.col(ts), interval).alias("ts")).agg(
        F.min_by(value, at).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, at).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Stored bars; filters on ticker and ts reach the scan."""
    return spark.read.parquet(path)


def select_range(bars: DataFrame, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """Bars with start <= ts < end; a missing bound is open."""
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        bars = bars.where(F.col("ts") < F.lit(str(end)).cast("timestamp_ntz"))
    return bars


def default_range(today: date | None = None) -> tuple[date, date]:
    """The last 365 days: from which day on, and before which, to select."""
    today = today or date.today()
    return today - timedelta(days=365), today


def require_rows(bars: DataFrame, what: str = "bars in the selected range") -> DataFrame:
    """The bars, if there are any. Runs a job that stops at the first row."""
    if bars.isEmpty():
        raise ValueError(f"there are no {what}")
    return bars


def select_period(bars: DataFrame, period: str) -> DataFrame:
    """Each ticker's bars later than its last bar less the period; `max` keeps all.

    The last bars come from an aggregation with one row per ticker, joined back, so
    no task has to hold all bars of a ticker.
    """
    if one_of("period", period, PERIODS) == "max":
        return bars
    last = bars.groupBy("ticker").agg(F.max("ts").alias("_last"))
    since = F.expr(f"_last - make_ym_interval(0, {PERIOD_MONTHS[period]})")
    return bars.join(last, "ticker").where(F.col("ts") > since).select(*bars.columns)


def from_wide(wide: DataFrame, ts: str, columns: dict[tuple[str, str], str]) -> DataFrame:
    """Bars of a frame with a column for each field and ticker; columns names them by (field, ticker).

    Fields a ticker lacks are null, and so are rows left out that have none of its fields.
    """
    tickers = sorted({t for _, t in columns})
    fields = ("open", "high", "low", "close", "volume")
    one = lambda t, f: F.col(f"`{columns[f, t]}`") if (f, t) in columns else F.lit(None)
    each = [F.struct(F.lit(t).alias("ticker"), *[one(t, f).cast("bigint" if f == "volume" else "double").alias(f) for f in fields]) for t in tickers]
    rows = wide.select(F.col(ts).alias("ts"), F.explode(F.array(*each)).alias("_bar"))
    return rows.select("_bar.ticker", "ts", *[f"_bar.{f}" for f in fields]).dropna("all", subset=list(fields))
