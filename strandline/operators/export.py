"""Forecasts as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.storage import kept


def export_rows(forecasts: DataFrame) -> DataFrame:
    """(Type, Step, Forecast_Value) of one ticker's forecast."""
    return forecasts.select(F.lit("Forecast").alias("Type"), F.col("step").alias("Step"), F.col("forecast_value").alias("Forecast_Value"))


def export_csv(forecasts: DataFrame, path: str) -> None:
    """One file with a header, in order of steps. A forecast has as many rows as its horizon.

    The rows name no ticker, so forecasts of several tickers are an error; `export_tickers` writes these. The
    forecasts are made once.
    """
    made = kept(forecasts, "export")
    tickers = made.select("ticker").distinct().limit(2).count()
    if tickers != 1:
        raise ValueError("there is no forecast to export" if not tickers else "there are forecasts of several tickers: choose one, or use export_tickers")
    export_rows(made).coalesce(1).sortWithinPartitions("Step").write.option("header", True).csv(path)


def export_tickers(forecasts: DataFrame, path: str) -> None:
    """A folder ticker=... for each ticker, each with its rows in order of steps. A ticker's rows go to one task, which has one for each step."""
    made = kept(forecasts, "export")
    if made.isEmpty():
        raise ValueError("there is no forecast to export")
    rows = made.select("ticker", F.lit("Forecast").alias("Type"), F.col("step").alias("Step"), F.col("forecast_value").alias("Forecast_Value"))
    rows.repartition("ticker").sortWithinPartitions("ticker", "Step").write.partitionBy("ticker").option("header", True).csv(path)
