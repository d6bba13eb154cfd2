"""Forecasters by name; each takes contexts and a config and adds `forecast array<double>`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from strandline.forecasters.baselines import drift, geometric
from strandline.forecasters.pretrained import pretrained

_KNOWN: dict[str, Callable] = {"drift": drift, "geometric": geometric, "pretrained": pretrained}


def register(name: str, forecaster: Callable) -> None:
    _KNOWN[name] = forecaster


def apply(contexts: DataFrame, cfg) -> DataFrame:
    """cfg.forecaster, or where it can't be loaded cfg.fallback if cfg.on_missing_model is 'mock'."""
    if cfg.forecaster not in _KNOWN:
        raise ValueError(f"unknown forecaster {cfg.forecaster!r}; known: {', '.join(sorted(_KNOWN))}")
    try:
        return _KNOWN[cfg.forecaster](contexts, cfg)
    except ModuleNotFoundError:
        if cfg.on_missing_model == "error":
            raise
        return _KNOWN[cfg.fallback](contexts, cfg)
