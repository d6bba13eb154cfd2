"""Contexts of a stream of bars: a context for each closed bar, from the last bars that the state keeps of its ticker.

The state of a ticker is its last context_length bars and the sum and number of its known values, whatever
the stream's length; it goes when nothing has come for the time-to-live. It stands in the query's
checkpoint, so a restarted query goes on where it was.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandline.config import one_of, round_context

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONTEXT = T.StructType([T.StructField(n, t) for n, t in (("ticker", T.StringType()), ("last_ts", T.TimestampNTZType()), ("n_raw", T.IntegerType()), ("n_padded", T.IntegerType()), ("context_length", T.IntegerType()), ("context", T.ArrayType(T.DoubleType())))])
KEPT = T.StructType([T.StructField("ts", T.ArrayType(T.LongType())), T.StructField("value", T.ArrayType(T.DoubleType())), T.StructField("sum", T.DoubleType()), T.StructField("count", T.LongType())])
EPOCH = pd.Timestamp(0)


class LastBars(StatefulProcessor):
    def __init__(self, context_length: int, impute: str, ttl_ms: int | None):
        self.n, self.impute, self.ttl_ms = context_length, impute, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bars", KEPT, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times, values, total, count = (list(x) if i < 2 else x for i, x in enumerate(self.state.get())) if self.state.exists() else ([], [], 0.0, 0)
        out = []
        for row in pd.concat(list(rows)).sort_values(["ts", "value"], kind="stable").itertuples():
            at = int((row.ts - EPOCH) / pd.Timedelta(microseconds=1))
            if times and at <= times[-1]:
                continue  # a bar that has been seen, or one before it
            value = float(row.value) if row.value is not None and math.isfinite(row.value) else math.nan
            if not math.isnan(value):
                total, count = total + value, count + 1
            times, values = [*times, at][-self.n :], [*values, value][-self.n :]
            if self.impute == "mean" and not count:
                continue
            fill = total / count if self.impute == "mean" else math.nan
            known = [fill if math.isnan(v) else v for v in values]
            out.append((key[0], row.ts, len(known), self.n - len(known), self.n, [known[0]] * (self.n - len(known)) + known))
        self.state.update((times, values, total, count))
        if out:
            yield pd.DataFrame(out, columns=CONTEXT.names)

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Chooses the state store that the state needs; before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def stream_contexts(series: DataFrame, context_length: int, impute: str = "mean", ttl: str | None = "30 days") -> DataFrame:
    """The contexts of `contexts` after each row of a stream (ticker, ts, value), in order of ts for each ticker.

    Values that are null, NaN or infinite are missing; with impute "mean" they are the mean of all known ones so
    far, and bars before the first known one give no context. A bar at or before the ticker's last is
    not counted again. Rows without ticker or ts are left out. ttl counts from a ticker's last row, by the clock, so the
    query goes on with empty batches; a replay that is to end by itself (availableNow) needs None.
    """
    use_state_store(series.sparkSession)
    whole = series.dropna("any", subset=["ticker", "ts"]).select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").cast("double").alias("value"))
    ttl_ms = None if ttl is None else int(pd.Timedelta(ttl) / pd.Timedelta(milliseconds=1))
    keeper = LastBars(round_context(context_length), one_of("impute", impute, ("mean", "none")), ttl_ms)
    return whole.groupBy("ticker").transformWithStateInPandas(keeper, outputStructType=CONTEXT, outputMode="Append", timeMode="None" if ttl is None else "ProcessingTime")
