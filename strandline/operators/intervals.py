"""Forecast intervals: quantiles of many hashed paths, or of a model, and their scores.

A path is a forecast with noise of its own, drawn by (ticker, step, seed, path), so paths are the same in every
partitioning. Paths are made and summed where the contexts are: a task sends one sketch or one group of
values for each ticker and step, whatever the number of paths.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import forecasters
from strandline.config import ForecastConfig
from strandline.forecasters.pretrained import pretrained_quantiles
from strandline.functions.calendars import future
from strandline.functions.series import known
from strandline.operators.context import contexts
from strandline.plans.pipeline import stepped

#: Of a sketch: about 1.65 % of rank error, twice K half of it (99 % of the time).
SKETCH_K = 200


def checked(levels: list[float]) -> list[float]:
    if not levels or sorted(set(levels)) != list(levels) or not all(0 < x < 1 for x in levels):
        raise ValueError(f"quantile levels must ascend between 0 and 1, not {levels}")
    return list(levels)


def paths(made: DataFrame, cfg: ForecastConfig, n: int, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(keys, path, step, forecast_ts, forecast_value) of n paths of each context, numbered from 1."""
    if n < 1:
        raise ValueError(f"the number of paths must be at least 1, not {n}")
    each = made.withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return stepped(forecasters.apply(each, replace(cfg, noise=True)), cfg, (*keys, "path"))


def path_intervals(drawn: DataFrame, levels: list[float], exact: bool = False, keys: tuple[str, ...] = ("ticker",), k: int = SKETCH_K) -> DataFrame:
    """(keys, step, forecast_ts, level, forecast_value): quantiles over paths.

    exact: interpolated between all values, which a step's values must fit into memory for; otherwise from
    KLL sketches of size k, which take the same few kilobytes for any number of paths.
    """
    by = (*keys, "step", "forecast_ts")
    if exact:
        found = drawn.groupBy(*by).agg(F.percentile("forecast_value", F.array(*[F.lit(x) for x in checked(levels)])).alias("_q"))
    else:
        found = sketches(drawn, by, k).withColumn("_q", F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(x)) for x in checked(levels)]))
    each = F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in levels]).alias("l"), F.col("_q").alias("v")))
    return found.select(*by, each.alias("_x")).select(*by, F.col("_x.l").alias("level"), F.col("_x.v").alias("forecast_value"))


def sketches(drawn: DataFrame, by: tuple[str, ...], k: int = SKETCH_K) -> DataFrame:
    """(by, sketch) of forecast values; sketches of more paths, days or tickers merge by kll_merge_agg_double."""
    return drawn.groupBy(*by).agg(F.kll_sketch_agg_double("forecast_value", F.lit(k)).alias("sketch"))


def forecast_intervals(series: DataFrame, cfg: ForecastConfig, levels: list[float], n_paths: int = 1000, exact: bool = False) -> DataFrame:
    """(ticker, step, forecast_ts, level, forecast_value) of series (ticker, ts, value).

    A pretrained forecaster gives its own quantiles; others give those of n_paths paths with noise.
    """
    made = contexts(series, cfg.context_length, cfg.impute, cfg.strict)
    if cfg.forecaster != "pretrained":
        return path_intervals(paths(made, cfg, n_paths), levels, exact)
    own = pretrained_quantiles(made, cfg, checked(levels)).withColumn("_at", future("last_ts", cfg.interval, cfg.horizon, cfg.calendar))
    steps = own.select("ticker", F.posexplode(F.arrays_zip(F.col("quantiles").alias("q"), F.col("_at").alias("t"))).alias("pos", "_s")).where("_s.q IS NOT NULL")
    each = F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in levels]).alias("l"), F.col("_s.q").alias("v")))
    return steps.select("ticker", (F.col("pos") + 1).alias("step"), F.col("_s.t").alias("forecast_ts"), each.alias("_x")).select("ticker", "step", "forecast_ts", F.col("_x.l").alias("level"), F.col("_x.v").alias("forecast_value"))


def interval_scores(intervals: DataFrame, actuals: DataFrame, *by: str) -> DataFrame:
    """(by, level, pinball, below, n_matched): mean pinball loss, and the part of actual values at or below the quantile.

    A well calibrated level has as large a part below it. Steps without a known actual value don't count.
    """
    real = actuals.select("ticker", F.col("ts").alias("forecast_ts"), known(F.col("value")).alias("_y")).where("_y IS NOT NULL")
    gap = F.col("_y") - F.col("forecast_value")
    loss = F.greatest(F.col("level") * gap, (F.col("level") - 1) * gap)
    met = intervals.join(real, ["ticker", "forecast_ts"])
    return met.groupBy(*by, "level").agg(F.avg(loss).alias("pinball"), F.avg((gap <= 0).cast("double")).alias("below"), F.count(F.lit(1)).alias("n_matched"))


def coverage(intervals: DataFrame, actuals: DataFrame, low: float, high: float, *by: str) -> DataFrame:
    """(by, coverage, width, n_matched): the part of known actual values between two levels, both included, and their mean distance."""
    real = actuals.select("ticker", F.col("ts").alias("forecast_ts"), known(F.col("value")).alias("_y")).where("_y IS NOT NULL")
    keys = [c for c in intervals.columns if c not in ("level", "forecast_value")]
    at = lambda x: F.max(F.when(F.col("level") == x, F.col("forecast_value")))
    both = intervals.groupBy(*keys).agg(at(low).alias("_low"), at(high).alias("_high")).join(real, ["ticker", "forecast_ts"])
    inside = ((F.col("_y") >= F.col("_low")) & (F.col("_y") <= F.col("_high"))).cast("double")
    return both.groupBy(*by).agg(F.avg(inside).alias("coverage"), F.avg(F.col("_high") - F.col("_low")).alias("width"), F.count(F.lit(1)).alias("n_matched"))
