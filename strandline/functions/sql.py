"""Forecasts from SQL: a table function over any table of bars.

    SELECT * FROM forecast_series(TABLE(bars) PARTITION BY ticker ORDER BY ts, horizon => 7, context_length => 64)

Arguments, all optional and constant: target, interval, context_length, horizon, forecaster ("drift",
"geometric" or "pretrained"), calendar, impute, noise, seed, repo, loader, style. Names, types and
values are checked when the query is analysed, as is that the table has ticker, ts and the target.

A partition is one series. The function keeps its last context_length rows only, but Spark has to bring all rows
of a ticker to one task first. `recent_view` makes a view with the last rows of each ticker and the
mean of its whole series (series_mean), cut off before the shuffle:

    recent_view(spark, bars, "recent", target="close", context_length=64)
    SELECT * FROM forecast_series(TABLE(recent) PARTITION BY ticker ORDER BY ts, ...)
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from strandline.config import ForecastConfig
from strandline.forecasters.baselines import DRIFT_NOISE, GEOMETRIC_MEAN, GEOMETRIC_SD
from strandline.forecasters.pretrained import cached_model, called, loader_of
from strandline.functions.calendars import listed
from strandline.functions.series import drawn_normal
from strandline.operators.context import last_n, means_of, target_of

RESULT = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("step", T.IntegerType()), T.StructField("forecast_ts", T.TimestampNTZType()), T.StructField("forecast_value", T.DoubleType())])
#: Arguments and the type that their constants must have.
ARGUMENTS = {"target": str, "interval": str, "context_length": int, "horizon": int, "forecaster": str, "calendar": str, "impute": str, "noise": bool, "seed": str, "repo": str, "loader": str, "style": str}
FORECASTERS = ("drift", "geometric", "pretrained")


@dataclass
class Checked(AnalyzeResult):
    """What analysis has found out, for the calls."""

    settings: str = ""


def settings_of(arguments: dict[str, object]) -> ForecastConfig:
    options = {k: arguments[k] for k in ("loader", "style") if k in arguments}
    known = {f.name for f in fields(ForecastConfig)}
    cfg = ForecastConfig(**{k: v for k, v in arguments.items() if k in known}, options=options)
    if cfg.forecaster not in FORECASTERS:
        raise ValueError(f"forecaster must be one of {', '.join(FORECASTERS)}, not {cfg.forecaster!r}")
    if cfg.forecaster == "pretrained":
        loader_of(cfg)
    return cfg


def one_forecast(ticker: str, context: np.ndarray, cfg: ForecastConfig) -> list[float]:
    """The forecaster's values after one padded context."""
    noise = [drawn_normal(ticker, i, cfg.seed) if cfg.noise else 0.0 for i in range(1, cfg.horizon + 1)]
    last = float(context[-1])
    if cfg.forecaster == "drift":
        slope, scale = (last - float(context[0])) / len(context), float(np.std(context)) * DRIFT_NOISE
        return [last + slope * i + scale * x for i, x in enumerate(noise, 1)]
    if cfg.forecaster == "geometric":
        out = []
        for x in noise:
            last *= 1.0 + (GEOMETRIC_MEAN + GEOMETRIC_SD * x)
            out.append(last)
        return out
    return called(cached_model(*loader_of(cfg)), [context.astype("float32")], cfg.horizon, cfg.options)[0].tolist()


class ForecastSeries:
    """The table function; an instance is one partition."""

    @staticmethod
    def analyze(bars: AnalyzeArgument, **arguments: AnalyzeArgument) -> Checked:
        if not bars.isTable:
            raise ValueError("the first argument must be a table: TABLE(bars) PARTITION BY ticker ORDER BY ts")
        given = {}
        for name, x in arguments.items():
            if name not in ARGUMENTS:
                raise ValueError(f"there is no argument {name}; there are {', '.join(ARGUMENTS)}")
            if not x.isConstantExpression or not isinstance(x.value, ARGUMENTS[name]) or (isinstance(x.value, bool) and ARGUMENTS[name] is not bool):
                raise ValueError(f"{name} must be a constant {ARGUMENTS[name].__name__}")
            given[name] = x.value
        cfg, columns = settings_of(given), {f.name.lower(): f.dataType for f in bars.dataType.fields}
        for need in ("ticker", "ts", cfg.target):
            if need not in columns:
                raise ValueError(f"the table has no column {need}")
        if not isinstance(columns["ts"], (T.TimestampNTZType, T.TimestampType, T.DateType)):
            raise ValueError(f"ts must be a timestamp, not {columns['ts'].simpleString()}")
        if not isinstance(columns[cfg.target], T.NumericType):
            raise ValueError(f"{cfg.target} must be a number, not {columns[cfg.target].simpleString()}")
        return Checked(schema=RESULT, settings=repr(sorted(given.items())))

    def __init__(self, checked: Checked):
        import ast

        self.cfg = settings_of(dict(ast.literal_eval(checked.settings)))
        self.rows: deque = deque(maxlen=self.cfg.effective_context_length)
        self.ticker, self.sum, self.count, self.mean = None, 0.0, 0, None

    def eval(self, row: Row, **arguments: object) -> None:
        if row["ts"] is None or row["ticker"] is None:
            return
        found = {k.lower(): row[k] for k in row.asDict()}
        value = found[self.cfg.target]
        value = float(value) if value is not None and math.isfinite(value) else None
        self.ticker, self.mean = found["ticker"], found.get("series_mean", self.mean)
        if value is not None:
            self.sum, self.count = self.sum + value, self.count + 1
        self.rows.append((found["ts"], value))

    def terminate(self) -> Iterator[tuple]:
        mean = self.mean if self.mean is not None else self.sum / self.count if self.count else None
        if not self.rows or (mean is None and self.cfg.impute == "mean"):
            return
        missing = mean if self.cfg.impute == "mean" else math.nan
        values = [missing if v is None else v for _, v in self.rows]
        n, last = self.cfg.effective_context_length, self.rows[-1][0]
        made = one_forecast(self.ticker, np.array([values[0]] * (n - len(values)) + values), self.cfg)
        for i, (at, value) in enumerate(zip(listed(last, self.cfg.interval, self.cfg.horizon, self.cfg.calendar), made, strict=False), 1):
            yield self.ticker, i, at, float(value)


def register(spark: SparkSession, name: str = "forecast_series") -> None:
    """Makes the table function known to the session's SQL."""
    spark.udtf.register(name, F.udtf(ForecastSeries))


def recent_view(spark: SparkSession, bars: DataFrame, name: str, target: str = "close", context_length: int = 512) -> None:
    """A view (ticker, ts, target, series_mean) of each ticker's last rows, as many as a context of that length has."""
    series = target_of(bars, target)
    n = ForecastConfig(context_length=context_length).effective_context_length
    rows = last_n(series, n).join(means_of(series), "ticker", "left")
    rows.select("ticker", "ts", F.col("value").alias(target), F.col("_mean").alias("series_mean")).createOrReplaceTempView(name)
