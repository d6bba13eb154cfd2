"""Scores of forecasts against later bars, and the frame a plot needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mae(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Per ticker: mean absolute error over the steps that have an actual value, and their number."""
    real = actuals.select("ticker", F.col("ts").alias("forecast_ts"), F.col("value").alias("_actual"))
    joined = forecasts.join(real, ["ticker", "forecast_ts"])
    return joined.groupBy("ticker").agg(F.avg(F.abs(F.col("forecast_value") - F.col("_actual"))).alias("mae_score"), F.count(F.lit(1)).alias("n_matched"))


def plot_frame(series: DataFrame, forecasts: DataFrame) -> DataFrame:
    """(ticker, ts, series, value): history, then the forecast joined on to the last actual value."""
    history = series.select("ticker", "ts", F.lit("history").alias("series"), "value")
    last = series.groupBy("ticker").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
    line = last.select("ticker", "ts", F.lit("forecast").alias("series"), "value")
    steps = forecasts.select("ticker", F.col("forecast_ts").alias("ts"), F.lit("forecast").alias("series"), F.col("forecast_value").alias("value"))
    return history.unionByName(line).unionByName(steps)
