"""Golden values of rounding, padding, imputation, forecasters, calendars, history and the model adapter."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline import ForecastConfig, forecast
from strandline.config import round_context
from strandline.forecasters.pretrained import cached_model, called, clear_cache, device, flat
from strandline.functions import calendars, series
from strandline.operators import context, export, history
from strandline.sources import bars
from strandline.streaming.bars import stream_bars

T0 = dt.datetime(2024, 1, 1)


def frame(spark, values, ticker="A"):
    rows = [(ticker, T0 + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, value double")


def test_rounding():
    assert [round_context(c) for c in (1, 31, 32, 33, 512, 1056)] == [32, 32, 32, 64, 512, 1056]
    for bad in (0, -5):
        with pytest.raises(ValueError):
            round_context(bad)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 10_000))
def test_rounding_property(c):
    n = round_context(c)
    assert n % 32 == 0 and c <= n < c + 32


def test_config_rejects():
    for bad in ({"interval": "2d"}, {"period": "9y"}, {"target": "x"}, {"horizon": 0}, {"context_length": 0}, {"backend": "abacus"}):
        with pytest.raises(ValueError):
            ForecastConfig(**bad)


def test_edge_pad(spark):
    got = spark.createDataFrame([([5.0, 6.0],), ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "v array<double>").select(series.edge_pad(F.col("v"), 5)).collect()
    assert [r[0] for r in got] == [[5, 5, 5, 5, 6], [2, 3, 4, 5, 6]]


def test_impute(spark):
    nan = float("nan")
    got = context.impute_mean(frame(spark, [10.0, nan, 12.0, None, 14.0])).orderBy("ts").collect()
    assert [r.value for r in got] == [10, 12, 12, 12, 14]
    long = context.contexts(frame(spark, [1.0] * 40 + [nan, 5.0]), 32).first()
    assert long.context[-2] == pytest.approx(1.0975609756097562)
    assert context.impute_mean(frame(spark, [nan, nan])).count() == 0
    with pytest.raises(Exception, match="no values"):
        context.impute_mean(frame(spark, [nan, None]), strict=True).collect()
    assert context.contexts(frame(spark, []), 32).count() == 0


def test_forecasts(spark):
    rows = frame(spark, [10.0, 12.0, 11.0, 15.0]).select("ticker", "ts", F.col("value").alias("close"))
    cfg = ForecastConfig(context_length=4, horizon=3)
    assert [r.forecast_value for r in forecast(rows, cfg).orderBy("step").collect()] == [15.15625, 15.3125, 15.46875]
    walk = ForecastConfig(context_length=4, horizon=3, forecaster="geometric")
    assert [r.forecast_value for r in forecast(rows, walk).orderBy("step").collect()] == [15.014999999999999, 15.030014999999997, 15.045045014999996]
    assert context.contexts(context.target_of(rows, "close"), 4).select(series.stddev_pop_of(F.col("context"))).first()[0] == pytest.approx(0.9354143466934853)


def test_noise_does_not_follow_partitions(spark):
    rows = frame(spark, [10.0, 12.0, 11.0, 15.0]).select("ticker", "ts", F.col("value").alias("close"))
    cfg = ForecastConfig(context_length=4, horizon=400, noise=True)
    a, b = ([r.forecast_value for r in forecast(rows.repartition(n), cfg).orderBy("step").collect()] for n in (1, 3))
    assert a == b
    noise = np.array(a) - (15 + 0.15625 * np.arange(1, 401))
    assert abs(noise.mean()) < 0.02 and noise.std() == pytest.approx(0.0935, rel=0.15)


D = dt.datetime
CALENDARS = [
    ("1d", "step", D(2024, 1, 5, 15, 30), [D(2024, 1, 8), D(2024, 1, 9), D(2024, 1, 10)]),
    ("1d", "step", D(2024, 1, 31), [D(2024, 2, 1), D(2024, 2, 2), D(2024, 2, 5)]),
    ("1wk", "anchored", D(2024, 1, 5, 15, 30), [D(2024, 1, 7, 16, 30), D(2024, 1, 14, 16, 30), D(2024, 1, 21, 16, 30)]),
    ("1wk", "anchored", D(2024, 1, 7), [D(2024, 1, 7, 1), D(2024, 1, 14, 1), D(2024, 1, 21, 1)]),
    ("1mo", "anchored", D(2024, 1, 31), [D(2024, 1, 31, 1), D(2024, 2, 29, 1), D(2024, 3, 31, 1)]),
    ("1mo", "anchored", D(2024, 1, 31, 23, 30), [D(2024, 2, 29, 0, 30), D(2024, 3, 31, 0, 30), D(2024, 4, 30, 0, 30)]),
    ("1h", "step", D(2024, 1, 31, 23, 30), [D(2024, 2, 1, 0, 30), D(2024, 2, 1, 1, 30), D(2024, 2, 1, 2, 30)]),
    ("1mo", "step", D(2024, 1, 31), [D(2024, 2, 29), D(2024, 3, 31), D(2024, 4, 30)]),
    ("1wk", "step", D(2024, 1, 5, 15, 30), [D(2024, 1, 12, 15, 30), D(2024, 1, 19, 15, 30), D(2024, 1, 26, 15, 30)]),
]


@pytest.mark.parametrize("interval,policy,start,want", CALENDARS)
def test_calendars(spark, interval, policy, start, want):
    df = spark.createDataFrame([(start,)], "t timestamp_ntz")
    assert df.select(calendars.future("t", interval, 3, policy)).first()[0] == want


def test_business_days_long(spark):
    df = spark.createDataFrame([(D(2024, 1, 5),)], "t timestamp_ntz")
    days = df.select(calendars.business_days("t", 399)).first()[0]
    assert len(days) == 399 and all(d.weekday() < 5 for d in days) and days == sorted(set(days))


def test_ranges(spark):
    rows = frame(spark, [float(i) for i in range(100)])
    assert bars.select_period(rows, "1mo").count() == 31
    assert bars.select_period(rows, "max").count() == 100
    assert bars.select_range(rows, "2024-01-02", "2024-01-04").count() == 2


def test_history(spark, tmp_path):
    rows = frame(spark, [10.0, 12.0, 11.0, 15.0]).select("ticker", "ts", F.col("value").alias("close"))
    made = forecast(rows, ForecastConfig(context_length=4, horizon=3))
    settings_ = {"interval": "1d", "context_length": 4, "horizon_length": 3, "model_repo": "m", "period": "max"}
    runs = str(tmp_path / "runs")
    for _ in range(2):
        history.save_runs(spark, runs, history.run_records(made, settings_))
    got = history.read_runs(spark, runs)
    assert [r.id for r in history.history_grid(got).collect()] == [2, 1]
    assert "forecast_data" not in history.history_grid(got).columns
    assert history.overlay(got, [2]).count() == 3
    history.delete_runs(spark, runs, str(tmp_path / "runs2"), got.where("id = 1"))
    assert [r.id for r in history.read_runs(spark, str(tmp_path / "runs2")).collect()] == [2]
    with pytest.raises(Exception, match="must not be null"):
        history.save_runs(spark, runs, history.run_records(made, settings_ | {"period": None}))
    with pytest.raises(ValueError):
        history.save_runs(spark, runs, history.run_records(made.where("false"), settings_))
    export.export_csv(made, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text[0] == "Type,Step,Forecast_Value" and text[1] == "Forecast,1,15.15625"


def test_adapter(spark):
    assert flat(np.ones((1, 3))).shape == (3,) and flat((np.ones((3, 1)), 0)).shape == (3,) and flat(np.float32(2)).shape == (1,)
    assert device("gpu", "Darwin") == "mps" and device("gpu", "Linux") == "cuda" and device("tpu") == "cpu" and device("mps", "Linux") == "cpu" and device("mps", "Darwin") == "mps"
    rows = frame(spark, [10.0, 15.0]).select("ticker", "ts", F.col("value").alias("close"))
    base = {"context_length": 4, "horizon": 2, "forecaster": "pretrained"}
    with pytest.raises(ModuleNotFoundError):
        forecast(rows, ForecastConfig(**base))
    assert forecast(rows, ForecastConfig(**base, on_missing_model="mock")).count() == 2
    got = forecast(rows, ForecastConfig(**base, options={"loader": "strandline.plans.queries:last_value_model"})).collect()
    assert [r.forecast_value for r in got] == [15, 15]


@pytest.fixture(params=["America/New_York", "Asia/Kolkata"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_bars_do_not_follow_the_session_zone(spark, zone, tmp_path):
    times = [D(2024, 3, 10, 2, 31, 7), D(2024, 3, 10, 2, 59), D(2024, 3, 10, 23, 59), D(2024, 11, 3, 1, 44, 59), D(2024, 3, 11)]
    ticks = spark.createDataFrame([("A", t, float(i), i) for i, t in enumerate(times)], "k string, ts timestamp_ntz, v double, o int")
    starts = lambda i: sorted(r.ts for r in bars.resample(ticks, "k", "ts", "v", "o", i).collect())
    assert starts("30m") == [D(2024, 3, 10, 2, 30), D(2024, 3, 10, 23, 30), D(2024, 3, 11), D(2024, 11, 3, 1, 30)]
    assert starts("1h") == [D(2024, 3, 10, 2), D(2024, 3, 10, 23), D(2024, 3, 11), D(2024, 11, 3, 1)]
    assert starts("1d") == [D(2024, 3, 10), D(2024, 3, 11), D(2024, 11, 3)]
    assert starts("1wk") == [D(2024, 3, 4), D(2024, 3, 11), D(2024, 10, 28)] and starts("1mo") == [D(2024, 3, 1), D(2024, 11, 1)]
    src = str(tmp_path / "ticks")
    ticks.unionByName(spark.createDataFrame([("A", D(2025, 1, 1), 0.0, 9)], ticks.schema)).write.parquet(src)
    for interval in ("1h", "1d", "1wk"):
        stream = stream_bars(spark.readStream.schema(ticks.schema).parquet(src), "k", "ts", "v", interval, order="o")
        name = f"bars_{interval}_{zone.replace('/', '_')}"
        stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        same = lambda df: sorted(map(tuple, df.select("ticker", "ts", "open", "close", "volume").collect()))
        assert same(spark.table(name)) == same(bars.resample(ticks, "k", "ts", "v", "o", interval))
    with pytest.raises(ValueError):
        stream_bars(ticks, "k", "ts", "v", "1mo")


def test_select_reports_nothing(spark):
    rows = frame(spark, [1.0])
    assert bars.require_rows(rows).count() == 1
    with pytest.raises(ValueError, match="no bars"):
        bars.require_rows(bars.select_range(rows, "2030-01-01"))
    assert bars.default_range(dt.date(2024, 12, 31)) == (dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    with pytest.raises(ValueError, match="no column"):
        context.target_of(rows, "close")


def test_from_wide(spark):
    wide = spark.createDataFrame([(T0, 1.0, 2.0, None, 7), (T0 + dt.timedelta(days=1), None, None, None, None)], "t timestamp_ntz, `Close.A` double, `Close.B` double, `Open.B` double, `Volume.A` long")
    got = bars.from_wide(wide, "t", {("close", "A"): "Close.A", ("close", "B"): "Close.B", ("open", "B"): "Open.B", ("volume", "A"): "Volume.A"})
    assert sorted((r.ticker, r.ts, r.open, r.close, r.volume) for r in got.collect()) == [("A", T0, None, 1.0, 7), ("B", T0, None, 2.0, None)]


class Styles:
    def forecast(self, arrays, freq=None):
        points = np.stack([np.full(2, a[-1] + (0 if freq is None else freq[0])) for a in arrays])
        return list(points) if freq is None else (points, np.zeros((len(arrays), 2, 9)))

    def predict_batch(self, arrays, horizon, return_quantiles=True):
        from types import SimpleNamespace

        return (SimpleNamespace(forecast=np.full(horizon, a[-1] * (10 if return_quantiles else 100))) for a in arrays)


def styles_loader(repo, backend, context_length, horizon, options):
    return Styles()


@pytest.mark.parametrize("options,want", [({"style": "forecast"}, 15), ({"style": "forecast_freq", "freq": 2}, 17), ({"style": "forecast_freq"}, 15), ({"style": "predict_batch"}, 150), ({"style": "predict_batch", "kwargs": {"return_quantiles": False}}, 1500)])
def test_call_styles(spark, options, want):
    rows = frame(spark, [10.0, 15.0]).unionByName(frame(spark, [10.0, 15.0], "B")).select("ticker", "ts", F.col("value").alias("close"))
    cfg = ForecastConfig(context_length=4, horizon=2, forecaster="pretrained", options={"loader": "tests.test_series:styles_loader"} | options)
    assert [r.forecast_value for r in forecast(rows, cfg).collect()] == [want] * 4


def test_model_cache_reloads_on_another_key():
    clear_cache()
    one = cached_model("tests.test_series:styles_loader", "r", "cpu", 32, 2, {})
    assert one is cached_model("tests.test_series:styles_loader", "r", "cpu", 32, 2, {})
    assert one is not cached_model("tests.test_series:styles_loader", "other", "cpu", 32, 2, {})
    with pytest.raises(ValueError):
        called(one, [], 2, {"style": "sing"})


def test_ids_are_never_given_twice(spark, tmp_path):
    rows = frame(spark, [10.0, 12.0]).select("ticker", "ts", F.col("value").alias("close"))
    made = forecast(rows, ForecastConfig(context_length=4, horizon=3))
    records = history.run_records(made, {"interval": "1d", "context_length": 4, "horizon_length": 3, "model_repo": "m", "period": "max"}, rows)
    a, b, c = (str(tmp_path / x) for x in "abc")
    history.save_runs(spark, a, records)
    history.save_runs(spark, a, records)
    history.delete_runs(spark, a, b, history.read_runs(spark, a).where("id = 2"))
    history.delete_runs(spark, b, c, history.read_runs(spark, b))
    assert history.read_runs(spark, c).count() == 0
    history.save_runs(spark, c, records)
    got = history.read_runs(spark, c).collect()
    assert [(r.id, r.last_ts) for r in got] == [(3, T0 + dt.timedelta(days=1))] and got[0].forecast_ts[0] > got[0].last_ts


def test_stream(spark, tmp_path):
    src = str(tmp_path / "ticks")
    spark.createDataFrame([("A", D(2024, 1, 1, 0, i), float(i)) for i in range(60)] + [("A", D(2024, 1, 2), 1.0)], "k string, ts timestamp_ntz, v double").write.parquet(src)
    stream = stream_bars(spark.readStream.schema("k string, ts timestamp_ntz, v double").parquet(src), "k", "ts", "v")
    q = stream.writeStream.outputMode("append").format("memory").queryName("bars_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    row = spark.table("bars_out").orderBy("ts").first()
    assert (row.open, row.high, row.low, row.close, row.volume) == (0.0, 59.0, 0.0, 59.0, 60)
