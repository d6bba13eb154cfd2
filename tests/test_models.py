"""Saving once, empty selections, exports of several tickers, eviction, and models from folders."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import ForecastConfig, forecast
from strandline.forecasters import saved
from strandline.forecasters.pretrained import evicted, free_workers
from strandline.operators import export, history
from strandline.operators.backtest import rolling_contexts

D = dt.datetime
SETTINGS = {"interval": "1d", "context_length": 4, "horizon_length": 3, "model_repo": "m", "period": "max"}


@pytest.fixture()
def bars(spark):
    rows = [(f"t{k}", D(2024, 1, 1) + dt.timedelta(days=i), float(k + i)) for k in range(5) for i in range(40)]
    return spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, close double")


def counting(tmp_path, **more):
    return ForecastConfig(context_length=4, horizon=3, forecaster="pretrained", options={"loader": "tests.models:counting", "folder": str(tmp_path)}, **more)


def test_saving_and_exporting_runs_a_forecaster_once(spark, bars, tmp_path):
    (tmp_path / "a").mkdir()
    records = history.run_records(forecast(bars, counting(tmp_path / "a")), SETTINGS, bars)
    history.save_runs(spark, str(tmp_path / "runs"), records)
    assert len(list((tmp_path / "a").glob("run-*"))) == 5
    assert history.read_runs(spark, str(tmp_path / "runs")).count() == 5
    (tmp_path / "b").mkdir()
    export.export_tickers(forecast(bars, counting(tmp_path / "b")), str(tmp_path / "csv"))
    assert len(list((tmp_path / "b").glob("run-*"))) == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).groupBy("ticker").count().where("count = 3").count() == 5


def test_empty_selection_is_an_error_or_empty(spark, bars):
    base = {"context_length": 4, "horizon": 3, "start": dt.date(2030, 1, 1)}
    with pytest.raises(ValueError, match="no close values"):
        forecast(bars, ForecastConfig(**base))
    assert forecast(bars, ForecastConfig(**base, on_empty="empty")).collect() == []
    with pytest.raises(ValueError, match="no close values"):
        forecast(bars.withColumn("close", F.lit(float("nan"))), ForecastConfig(context_length=4))
    with pytest.raises(ValueError, match="on_empty"):
        ForecastConfig(on_empty="maybe")


def test_several_tickers_are_not_mixed(bars, tmp_path):
    made = forecast(bars, ForecastConfig(context_length=4, horizon=3))
    with pytest.raises(ValueError, match="several tickers"):
        export.export_csv(made, str(tmp_path / "x"))
    with pytest.raises(ValueError, match="no forecast"):
        export.export_csv(made.where("false"), str(tmp_path / "x"))
    export.export_csv(made.where("ticker = 't1'"), str(tmp_path / "one"))
    assert len(next((tmp_path / "one").glob("*.csv")).read_text().splitlines()) == 4


def test_another_token_frees_the_model(spark, bars, tmp_path):
    cfg, cached = counting(tmp_path), bars.coalesce(1).cache()
    cached.count()
    first = sorted(map(tuple, forecast(cached, cfg).coalesce(1).collect()))
    assert not list(tmp_path.glob("freed-*")) and cached.is_cached
    again = evicted(cfg, cached)
    assert not cached.is_cached and again.options["token"] != cfg.options.get("token")
    for _ in range(4):  # until a worker that held the first model has run again
        assert sorted(map(tuple, forecast(cached, again).coalesce(1).collect())) == first
    freed, loaded = ({x.name.split("-")[1] for x in tmp_path.glob(f"{what}-*")} for what in ("freed", "loaded"))
    assert freed and freed <= loaded


def test_eviction_reaches_a_worker_behind_many_idle_ones(spark, bars, tmp_path):
    def waiting(batches):
        time.sleep(1)
        yield from batches

    crowd = spark.range(0, 16, 1, 8)
    for _ in range(2):  # three workers a task: more are idle afterwards than a few forecasts would meet
        crowd = crowd.mapInArrow(waiting, "id long")
    crowd.mapInArrow(waiting, "id long").count()
    cfg = counting(tmp_path)
    first = sorted(map(tuple, forecast(bars, cfg).collect()))
    loaded = sorted(x.name.split("-")[1] for x in tmp_path.glob("loaded-*"))
    assert loaded and not list(tmp_path.glob("freed-*"))
    again = evicted(cfg)
    assert sorted(x.name.split("-")[1] for x in tmp_path.glob("freed-*")) == loaded
    assert sorted(map(tuple, forecast(bars, again).collect())) == first
    assert free_workers(spark) >= 12


def test_linear_model_is_fitted_saved_and_loaded_by_name(spark, tmp_path):
    rows = []
    for k in range(6):
        x = 50 + 10 * np.sin(np.arange(260) / (5 + k))
        rows += [(f"t{k}", D(2023, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)]
    series = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, value double")
    cuts = [D(2023, 2, 10) + dt.timedelta(days=i) for i in range(150)]
    made = rolling_contexts(series, cuts, 32)
    later = rolling_contexts(series, [c + dt.timedelta(days=3) for c in cuts], 32).select("ticker", (F.col("origin") - F.expr("INTERVAL 3 DAYS")).alias("origin"), F.slice("context", -3, 3).alias("future"))
    model = saved.fit_linear(made.join(later, ["ticker", "origin"]), 16, 3, 0.01)
    model.save(f"{tmp_path}/models/sine")
    bars = series.withColumnRenamed("value", "close").where(F.col("ts") < F.lit("2023-09-10").cast("timestamp_ntz"))
    base = {"context_length": 32, "horizon": 3, "interval": "1d", "forecaster": "pretrained"}
    for repo, options in ((f"{tmp_path}/models/sine", {}), ("sine", {"models": f"file://{tmp_path}/models"})):
        cfg = ForecastConfig(**base, repo=repo, options={"loader": "strandline.forecasters.saved:load"} | options)
        got = forecast(bars, cfg).collect()
        # steps of the fit are calendar days
        real = {(t, ts): v for t, ts, v in rows}
        last = {t: D(2023, 9, 9) for t in {r[0] for r in rows}}
        assert len(got) == 18 and max(abs(r.forecast_value - real[r.ticker, last[r.ticker] + dt.timedelta(days=r.step)]) for r in got) < 0.5
    missing = ForecastConfig(**base, repo=f"{tmp_path}/none", options={"loader": "strandline.forecasters.saved:load"})
    with pytest.raises(Exception, match="no model at"):
        forecast(bars, missing).collect()
    with pytest.raises(ModuleNotFoundError):
        forecast(bars, ForecastConfig(**base, options={"loader": "not-installed"}))
    with pytest.raises(Exception, match="needs 16 values"):
        forecast(bars, ForecastConfig(**(base | {"horizon": 9}), repo=f"{tmp_path}/models/sine", options={"loader": "strandline.forecasters.saved:load"})).collect()
