"""The whole run: range, target, imputation, context, forecast, future timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import forecasters
from strandline.config import ForecastConfig
from strandline.functions.calendars import future
from strandline.operators.context import contexts, target_of
from strandline.sources.bars import select_period, select_range
from strandline.storage import kept


def prepared(bars: DataFrame, cfg: ForecastConfig) -> DataFrame:
    rows = select_period(bars, cfg.period) if cfg.period else select_range(bars, cfg.start, cfg.end)
    return contexts(target_of(rows, cfg.target), cfg.context_length, cfg.impute, cfg.strict)


def stepped(made: DataFrame, cfg: ForecastConfig, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(keys, step, forecast_ts, forecast_value) of contexts with a forecast; steps count from 1."""
    stamped = made.withColumn("_at", future("last_ts", cfg.interval, cfg.horizon, cfg.calendar))
    rows = stamped.select(*keys, F.posexplode(F.arrays_zip(F.col("forecast").alias("v"), F.col("_at").alias("t"))))
    return rows.where(F.col("col.v").isNotNull()).select(*keys, (F.col("pos") + 1).alias("step"), F.col("col.t").alias("forecast_ts"), F.col("col.v").alias("forecast_value"))


def found(made: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """The contexts; with cfg.on_empty "error" they are stored, one row for each ticker, and must not be none."""
    if cfg.on_empty == "empty":
        return made
    made = kept(made, "contexts")
    if made.isEmpty():
        raise ValueError(f"there are no {cfg.target} values to forecast from in the selected range")
    return made


def forecast(bars: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """(ticker, step, forecast_ts, forecast_value); steps count from 1.

    With cfg.on_empty "error" the contexts are made at once and an empty selection is an error; with "empty"
    everything is lazy. The forecaster itself runs when the result is read.
    """
    return stepped(forecasters.apply(found(prepared(bars, cfg), cfg), cfg), cfg)
