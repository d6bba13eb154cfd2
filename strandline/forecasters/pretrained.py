"""Adapter for models that live in Python: one load per worker, one call per Arrow batch.

A model is named by options["loader"] = "package.module:function", or by the name of an installed package's entry
point (see `saved`, which also loads models from folders). The function gets
(repo, device, context_length, horizon, options) and returns the model. options["style"] says
how it is called with a list of float32 arrays:

call           model(arrays), the default
forecast       model.forecast(arrays)
forecast_freq  model.forecast(arrays, freq=[options["freq"] or 0, one for each array])
predict_batch  model.predict_batch(arrays, horizon=horizon, **options["kwargs"])

It returns one forecast per array, or a pair of these and of quantiles: for each array those of
options["levels"] at each step, (h, levels), or with the mean before them, (h, 1 + levels). `pretrained` gives the
forecasts only, `pretrained_quantiles` the quantiles too. A forecast is an array, a (1, h) or (h, 1) array, a (points, quantiles) pair, or an object
with the attribute `forecast`.
"""

from __future__ import annotations

import importlib.metadata
import importlib.util
import os
import platform
import uuid
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import one_of
from strandline.forecasters.saved import GROUP, by_name

STYLES = ("call", "forecast", "forecast_freq", "predict_batch")
#: Of tasks that free workers, at most: other jobs may start new workers all the time.
ROUNDS = 20
_models: dict[tuple, object] = {}


def device(backend: str, system: str | None = None) -> str:
    """The name a tensor library knows: gpu is mps on Macs and cuda elsewhere; mps off a Mac and tpu fall back to cpu."""
    mac = (system or platform.system()) == "Darwin"
    if backend == "gpu":
        return "mps" if mac else "cuda"
    return "mps" if backend == "mps" and mac else "cpu"


def flat(out) -> np.ndarray:
    """A forecast as a one-dimensional float64 array."""
    if hasattr(out, "forecast"):
        out = out.forecast
    if isinstance(out, tuple):
        out = out[0]
    a = np.asarray(out, dtype="float64")
    if a.ndim > 1:
        a = a.reshape(-1) if 1 in a.shape else a[:, 0]
    return np.atleast_1d(a)


def cached_model(loader: str, repo: str, backend: str, context: int, horizon: int, options: dict):
    """The worker's model; another key loads anew and drops the old one."""
    key = (loader, repo, backend, context, horizon, repr(sorted(options.items())))
    if key not in _models:
        _models.clear()
        _models[key] = by_name(loader)(repo, device(backend), context, horizon, options)
    return _models[key]


def answered(model, arrays: list[np.ndarray], horizon: int, options: dict):
    """What the model returns for the arrays, by the style of options."""
    style = one_of("style", options.get("style", "call"), STYLES)
    if style == "call":
        return model(arrays)
    if style == "forecast":
        return model.forecast(arrays)
    if style == "forecast_freq":
        return model.forecast(arrays, freq=[options.get("freq") or 0] * len(arrays))
    return model.predict_batch(arrays, horizon=horizon, **options.get("kwargs", {}))


def points(out, n: int) -> list[np.ndarray]:
    found = [flat(x) for x in (out[0] if isinstance(out, tuple) else out)]
    if len(found) != n:
        raise ValueError(f"the model gave {len(found)} forecasts for {n} series")
    return found


def called(model, arrays: list[np.ndarray], horizon: int, options: dict) -> list[np.ndarray]:
    """One flat forecast per array."""
    return points(answered(model, arrays, horizon, options), len(arrays))


def quantiles(out, n: int, levels: int) -> list[np.ndarray]:
    """(steps, levels) for each of n arrays: the second of a pair, or the second of each forecast's pair, or its attribute `quantiles`."""
    pair = isinstance(out, tuple)
    made = list(out[1]) if pair and out[1] is not None else [x[1] if isinstance(x, tuple) else getattr(x, "quantiles", None) for x in (out[0] if pair else out)]
    if len(made) != n or any(x is None for x in made):
        raise ValueError("the model gave no quantiles")
    found = [np.asarray(x, "float64") for x in made]
    if any(x.ndim != 2 or x.shape[1] not in (levels, levels + 1) for x in found):
        raise ValueError(f"quantiles must be {levels} a step, not of shape {found[0].shape}")
    return [x[:, -levels:] for x in found]


def clear_cache() -> None:
    """Drops this process's model. Workers drop theirs in `free_workers`, or when they are given another key: options["token"] is part of it."""
    _models.clear()


def free_workers(spark: SparkSession) -> int:
    """Drops the models of idle workers; returns how many workers were met.

    An executor hands out the worker that has been idle longest, so a round of tasks that meets no new one has met all.
    Workers that are busy just now, and executors that are busy throughout, are not met.
    """
    n, met = 4 * spark.sparkContext.defaultParallelism, set()
    if spark.sparkContext.getConf().get("spark.python.worker.reuse", "true").lower() == "false":
        return 0  # no worker outlives its task

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            clear_cache()
            yield pd.Series([f"{platform.node()} {os.getpid()}"] * len(batch))

    for _ in range(ROUNDS):
        found = {r[0] for r in spark.range(0, n, 1, n).select(run("id")).collect()}
        if found <= met:
            break
        met |= found
    return len(met)


def evicted(cfg, *frames: DataFrame):
    """cfg with a new token, and frames no longer cached.

    Idle workers free their models at once, whichever hold one. A busy worker frees its own when it next forecasts
    with the returned config, for which all load the model anew; results are the same. Workers without further
    work end with their executor's idle time.
    """
    for frame in frames:
        frame.unpersist(blocking=True)
    clear_cache()
    if spark := frames[0].sparkSession if frames else SparkSession.getActiveSession():
        free_workers(spark)
    return replace(cfg, options=dict(cfg.options) | {"token": uuid.uuid4().hex})


def loader_of(cfg) -> tuple:
    """The arguments of `cached_model`; fails where the model's package isn't installed."""
    loader = cfg.options.get("loader", "")
    module, _, name = loader.partition(":")
    if not module or (importlib.util.find_spec(module) is None if name else not importlib.metadata.entry_points(group=GROUP, name=loader)):
        raise ModuleNotFoundError(f"no forecasting model: options['loader'] is {loader!r}")
    options = dict(cfg.options)
    one_of("style", options.get("style", "call"), STYLES)
    return loader, cfg.repo, cfg.backend, cfg.effective_context_length, cfg.horizon, options


def pretrained(contexts: DataFrame, cfg) -> DataFrame:
    args, cfg_horizon = loader_of(cfg), cfg.horizon
    options = args[-1]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            model = cached_model(*args)
            yield pd.Series(called(model, [np.asarray(c, "float32") for c in batch], cfg_horizon, options))

    return contexts.withColumn("forecast", run(F.col("context").cast("array<float>")))


def pretrained_quantiles(contexts: DataFrame, cfg, levels: list[float]) -> DataFrame:
    """contexts with forecast and quantiles array<array<double>>: for each step those of levels, from one call of the model."""
    args, cfg_horizon = loader_of(cfg), cfg.horizon
    options = args[-1] | {"levels": list(levels)}
    args = (*args[:-1], options)

    @F.pandas_udf("struct<forecast: array<double>, quantiles: array<array<double>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            model, n = cached_model(*args), len(batch)
            out = answered(model, [np.asarray(c, "float32") for c in batch], cfg_horizon, options)
            yield pd.DataFrame({"forecast": points(out, n), "quantiles": [[row.tolist() for row in x] for x in quantiles(out, n, len(levels))]})

    return contexts.withColumn("_made", run(F.col("context").cast("array<float>"))).select(*contexts.columns, "_made.*")
