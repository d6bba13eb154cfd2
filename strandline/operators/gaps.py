"""Missing bars: every bar of the grid between a ticker's first and last known value, with values for those that are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import INTERVALS, one_of
from strandline.functions.series import known
from strandline.operators.ranges import SPAN_OF, carried, span_start
from strandline.sources.bars import bar_start
from strandline.storage import kept

METHODS = ("last", "linear")
STEP = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour", "1d": "1 day", "1wk": "7 days", "1mo": "1 month"}


def grid(known_bars: DataFrame, interval: str) -> DataFrame:
    """(ticker, ts) of every bar from a ticker's first to its last; each range of time makes its own bars."""
    span, step = SPAN_OF[one_of("interval", interval, INTERVALS)], STEP[interval]
    ends = known_bars.groupBy("ticker").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    spans = ends.select("ticker", "_first", "_last", F.explode(F.sequence(span_start(F.col("_first"), span), span_start(F.col("_last"), span), F.expr(f"INTERVAL 1 {span}"))).alias("_span"))
    opens = F.col("_span").cast("timestamp_ntz")
    first = bar_start(opens + F.expr("INTERVAL 6 DAYS"), "1wk") if interval == "1wk" else opens
    start, stop = F.greatest("_first", first), F.least("_last", opens + F.expr(f"INTERVAL 1 {span}") - F.expr("INTERVAL 1 SECOND"))
    bars = F.when(start <= stop, F.sequence(start, stop, F.expr(f"INTERVAL {step}")))
    return spans.select("ticker", F.explode(bars).alias("ts"))


def _on_grid(rows: DataFrame, interval: str, values: Column) -> DataFrame:
    """(ticker, ts, _known) over the whole grid, kept: the last row of each bar, ties the greatest."""
    at = F.struct("ts", F.col("_known"))
    bars = rows.select("ticker", "ts", values.alias("_known")).where(F.col("_known").isNotNull() & F.col("ticker").isNotNull() & F.col("ts").isNotNull())
    bars = kept(bars.groupBy("ticker", bar_start(F.col("ts"), interval).alias("_bar")).agg(F.max_by("_known", at).alias("_known")).select("ticker", F.col("_bar").alias("ts"), "_known"), "known-bars")
    return kept(grid(bars, interval).join(bars, ["ticker", "ts"], "left"), "grid")


def fill_series(series: DataFrame, interval: str, method: str = "last") -> DataFrame:
    """(ticker, ts, value, filled) of series (ticker, ts, value) without gaps.

    last: a missing value is the last known one before it; linear: on the line between the known ones around
    it. Null, NaN and infinite values are missing, as are bars without a row. Rows before a
    ticker's first known value and after its last are left out, and so are tickers without any.
    """
    one_of("method", method, METHODS)
    value = known(F.col("value"))
    whole = _on_grid(series, interval, F.when(value.isNotNull(), F.struct("ts", value.alias("value"))))
    span, filled = SPAN_OF[interval], F.col("_known").isNull().alias("filled")
    if method == "last":
        return carried(whole, ["ticker"], ["ts"], span, {"_from": ("_known", "last")}).select("ticker", "ts", F.col("_from.value").alias("value"), filled)
    both = carried(whole.withColumn("_point", F.when(F.col("_known").isNotNull(), F.struct("ts", F.col("_known.value").alias("value")))), ["ticker"], ["ts"], span, {"_from": ("_point", "last"), "_to": ("_point", "next")})
    seconds = lambda a, b: F.expr(f"cast(timestampdiff(MICROSECOND, {a}, {b}) as double)")
    part = seconds("_from.ts", "ts") / seconds("_from.ts", "_to.ts")
    line = F.col("_from.value") + (F.col("_to.value") - F.col("_from.value")) * part
    return both.select("ticker", "ts", F.when(F.col("_known").isNull(), line).otherwise(F.col("_known.value")).alias("value"), filled)


def fill_bars(bars: DataFrame, interval: str) -> DataFrame:
    """Bars without gaps, and filled: a missing bar opens, closes and stays at the last close, with volume 0.

    Bars without a finite close are missing.
    """
    fields = ("open", "high", "low", "close", "volume")
    whole = _on_grid(bars, interval, F.when(known(F.col("close")).isNotNull(), F.struct(*fields)))
    close = carried(whole.withColumn("_close", F.col("_known.close")), ["ticker"], ["ts"], SPAN_OF[interval], {"_from": ("_close", "last")})
    none = F.col("_known").isNull()
    flat = [F.when(none, F.lit(0) if f == "volume" else F.col("_from")).otherwise(F.col(f"_known.{f}")).alias(f) for f in fields]
    return close.select("ticker", "ts", *flat, none.alias("filled"))
