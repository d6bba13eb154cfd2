"""Strandline: preparing, forecasting and scoring many time series on Spark."""

from strandline.config import ForecastConfig
from strandline.plans.pipeline import forecast

__all__ = ["ForecastConfig", "forecast"]
