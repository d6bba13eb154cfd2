"""Forecasters made of array expressions only; they run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.series import hashed_normal, stddev_pop_of

# Mean and deviation of the geometric walk's steps; noise of the drift as a part of the deviation.
GEOMETRIC_MEAN, GEOMETRIC_SD, DRIFT_NOISE = 0.001, 0.015, 0.1


def _noise(contexts: DataFrame, cfg, step: Column) -> Column:
    """Drawn by ticker, step and seed, and by the path of contexts that have one."""
    path = [F.col("path")] if "path" in contexts.columns else []
    return hashed_normal(F.col("ticker"), step, F.lit(cfg.seed), *path) if cfg.noise else F.lit(0.0)


def drift(contexts: DataFrame, cfg) -> DataFrame:
    """last + drift * step + noise; drift is (last - first) / context length."""
    ctx = F.col("context")
    last = F.element_at(ctx, -1)
    slope = (last - ctx[0]) / F.greatest(F.lit(1), F.size(ctx))
    scale = stddev_pop_of(ctx) * DRIFT_NOISE if cfg.noise else F.lit(0.0)
    with_parts = contexts.withColumns({"_last": last, "_slope": slope, "_scale": scale})
    made = F.transform(F.sequence(F.lit(1), F.lit(cfg.horizon)), lambda i: F.col("_last") + F.col("_slope") * i + F.col("_scale") * _noise(contexts, cfg, i))
    return with_parts.withColumn("forecast", made).drop("_last", "_slope", "_scale")


def geometric(contexts: DataFrame, cfg) -> DataFrame:
    """x * (1 + step), folded from the last value on."""
    start = F.array(F.element_at("context", -1))
    grow = lambda a, i: F.concat(a, F.array(F.element_at(a, -1) * (1.0 + (GEOMETRIC_MEAN + GEOMETRIC_SD * _noise(contexts, cfg, i)))))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(cfg.horizon)), start, grow)
    return contexts.withColumn("forecast", F.slice(walk, 2, cfg.horizon))
