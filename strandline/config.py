"""Validated settings of a forecast run."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# The domains the settings may take.
INTERVALS = ("1m", "5m", "15m", "30m", "1h", "1d", "1wk", "1mo")
PERIODS = ("1mo", "3mo", "6mo", "1y", "2y", "5y", "max")
TARGETS = ("open", "high", "low", "close", "volume")
BACKENDS = ("cpu", "gpu", "tpu", "mps")
PATCH = 32


def round_context(length: int) -> int:
    """The context length a model accepts: the next multiple of the patch size."""
    if length < 1:
        raise ValueError(f"context length must be at least 1, not {length}")
    return -(-length // PATCH) * PATCH


def one_of(what: str, value: str, domain: tuple[str, ...]) -> str:
    if value not in domain:
        raise ValueError(f"{what} must be one of {', '.join(domain)}, not {value!r}")
    return value


@dataclass(frozen=True)
class ForecastConfig:
    """Either period or start/end selects the rows; both None keeps all.

    on_empty says what a selection without any context gives: an error, or an empty result.
    """

    interval: str = "1d"
    period: str | None = None
    start: date | None = None
    end: date | None = None
    target: str = "close"
    context_length: int = 512
    horizon: int = 30
    forecaster: str = "drift"
    on_missing_model: str = "error"
    fallback: str = "geometric"
    calendar: str = "step"
    impute: str = "mean"
    strict: bool = False
    on_empty: str = "error"
    noise: bool = False
    seed: str = "0"
    backend: str = "cpu"
    repo: str = ""
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        one_of("interval", self.interval, INTERVALS)
        one_of("target", self.target, TARGETS)
        one_of("backend", self.backend, BACKENDS)
        one_of("calendar", self.calendar, ("step", "anchored"))
        one_of("impute", self.impute, ("mean", "none"))
        one_of("on_empty", self.on_empty, ("error", "empty"))
        one_of("on_missing_model", self.on_missing_model, ("error", "mock"))
        if self.period is not None:
            one_of("period", self.period, PERIODS)
            if self.start or self.end:
                raise ValueError("give a period or a date range, not both")
        if self.horizon < 1:
            raise ValueError(f"horizon must be at least 1, not {self.horizon}")
        round_context(self.context_length)

    @property
    def effective_context_length(self) -> int:
        return round_context(self.context_length)
