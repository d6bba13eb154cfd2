"""Positions, carries, as-of matches, filled gaps, rolling backtests and intervals against plain Python; hot tickers, nulls, ties, range borders."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import ForecastConfig
from strandline.operators import backtest, gaps, intervals, ranges
from strandline.operators.context import contexts
from strandline.plans.pipeline import forecast

D = dt.datetime
SERIES = "ticker string, ts timestamp_ntz, value double"
NAN = float("nan")


def walk(seed, n=900, tickers=("hot", "b", "c")):
    """Rows over several years, two thirds of them of one ticker, with nulls, NaN and gaps."""
    rng = random.Random(seed)
    rows = {}
    for _ in range(n):
        t = rng.choice((tickers[0],) * 4 + tickers)
        rows[t, D(2020, 1, 1) + dt.timedelta(days=rng.randrange(1200))] = rng.choice([rng.random() * 100] * 6 + [None, NAN])
    return [(t, ts, v) for (t, ts), v in rows.items()]


def no_window_over_a_series(df):
    """No window orders rows by their time within a ticker alone."""
    plan = df._jdf.queryExecution().analyzed().toString()
    specs = re.findall(r"windowspecdefinition\(([^()]*)", plan)
    return specs and not [s for s in specs if re.match(r"ticker#\d+, (_at|ts)#\d+ ", s)]


@pytest.mark.parametrize("span", ranges.SPANS)
def test_positions(spark, span):
    rows = walk(1) + [("b", None, 1.0), (None, D(2020, 1, 1), 2.0)]
    got = ranges.positions(spark.createDataFrame(rows, SERIES).repartition(5), ["ticker"], "ts", span)
    assert no_window_over_a_series(got)
    for t in ("hot", "b", "c"):
        assert [r.position for r in got.where(F.col("ticker") == t).orderBy("ts").collect()] == list(range(sum(r[0] == t and r[1] is not None for r in rows)))
    assert got.count() == len(rows) - 2


def brute_as_of(left, right, tolerance):
    out = []
    for k, ts, name in left:
        best = max(((x, v is not None, v or 0, v) for t, x, v in right if t is not None and t == k and x is not None and ts is not None and x <= ts), default=None)
        good = best is not None and (tolerance is None or best[0] >= ts - tolerance)
        out.append((k, ts, name, best[0] if good else None, best[3] if good else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tolerance", [None, 3])
@pytest.mark.parametrize("span", ranges.SPANS)
def test_as_of(spark, tolerance, span):
    rng = random.Random(8)
    at = lambda: D(2020, 12, 1) + dt.timedelta(hours=rng.randrange(24 * 70))
    left = [(rng.choice(["hot"] * 5 + ["b", "none", None]), rng.choice([at(), at(), None]), f"x{i % 40}") for i in range(300)]
    right = [(rng.choice(["hot"] * 5 + ["b", None]), rng.choice([at()] * 5 + [None]), rng.choice([None, 1.5, 2.5, 3.5])) for _ in range(260)]
    right += right[:40] + [(t, ts, 0.5) for t, ts, _ in right[:60]]  # repeats and ties
    got = ranges.as_of(spark.createDataFrame(left, "ticker string, at timestamp_ntz, name string"), spark.createDataFrame(right, SERIES), ["ticker"], "at", "ts", ["value"], tolerance and f"{tolerance} days", span)
    assert no_window_over_a_series(got)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_as_of(left, right, tolerance and dt.timedelta(days=tolerance))


def test_as_of_empty_and_weekend(spark):
    bars = spark.createDataFrame([("A", D(2024, 1, 4), 1.0), ("A", D(2024, 1, 5), 2.0)], SERIES)
    asks = spark.createDataFrame([("A", D(2024, 1, 7)), ("A", D(2024, 1, 9)), ("A", D(2024, 1, 3))], "ticker string, at timestamp_ntz")
    got = {r["at"].day: (r.matched_ts and r.matched_ts.day, r.value) for r in ranges.as_of(asks, bars, ["ticker"], "at", "ts", ["value"], "2 days").collect()}
    assert got == {7: (5, 2.0), 9: (None, None), 3: (None, None)}
    assert ranges.as_of(asks.limit(0), bars, ["ticker"], "at", "ts", ["value"]).collect() == []
    assert ranges.as_of(asks, bars.limit(0), ["ticker"], "at", "ts", ["value"]).where("value IS NULL").count() == 3


def good(v):
    return v is not None and np.isfinite(v)


@pytest.mark.parametrize("interval,step", [("1h", dt.timedelta(hours=1)), ("1d", dt.timedelta(days=1)), ("1wk", dt.timedelta(days=7)), ("15m", dt.timedelta(minutes=15))])
@pytest.mark.parametrize("method", gaps.METHODS)
def test_fill(spark, interval, step, method):
    rng = random.Random(interval)
    start = D(2023, 12, 18)  # a Monday; gaps cross days, months and years
    rows = [(t, start + step * rng.randrange(180), rng.choice([rng.random()] * 4 + [None, NAN, float("inf")])) for t in ["hot"] * 60 + ["b"] * 8]
    rows = list({(t, ts): (t, ts, v) for t, ts, v in rows}.values()) + [("none", start, NAN), ("none", start + step * 5, None), (None, start, 1.0)]
    got = gaps.fill_series(spark.createDataFrame(rows, SERIES).repartition(3), interval, method)
    assert no_window_over_a_series(got)
    want = []
    for t in ("hot", "b"):
        have = sorted((ts, v) for k, ts, v in rows if k == t and good(v))
        ts = have[0][0]
        while ts <= have[-1][0]:
            before, after = max(x for x in have if x[0] <= ts), min(x for x in have if x[0] >= ts)
            v = before[1] if method == "last" or before == after else before[1] + (after[1] - before[1]) * ((ts - before[0]) / (after[0] - before[0]))
            want.append((t, ts, pytest.approx(v), before[0] != ts))
            ts += step
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_fill_months_ties_and_bars(spark):
    rows = [("A", D(2023, 11, 1), 1.0), ("A", D(2023, 11, 1), 3.0), ("A", D(2023, 11, 20), 3.5), ("A", D(2024, 3, 9), 7.0)]
    got = gaps.fill_series(spark.createDataFrame(rows, SERIES), "1mo", "last").orderBy("ts").collect()
    assert [(r.ts.month, r.value, r.filled) for r in got] == [(11, 3.5, False), (12, 3.5, True), (1, 3.5, True), (2, 3.5, True), (3, 7.0, False)]
    bars = spark.createDataFrame([("A", D(2023, 12, 31), 1.0, 4.0, 0.5, 2.0, 9), ("A", D(2024, 1, 2), 3.0, 3.0, 3.0, 3.0, 1)], "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint")
    assert [tuple(r)[2:] for r in gaps.fill_bars(bars, "1d").orderBy("ts").collect()] == [(1.0, 4.0, 0.5, 2.0, 9, False), (2.0, 2.0, 2.0, 2.0, 0, True), (3.0, 3.0, 3.0, 3.0, 1, False)]
    assert gaps.fill_series(spark.createDataFrame([], SERIES), "1d").collect() == []
    with pytest.raises(ValueError, match="method"):
        gaps.fill_series(bars, "1d", "cubic")


CUTS = [dt.date(2019, 1, 1), dt.date(2020, 3, 1), D(2020, 3, 1, 12), D(2021, 1, 1), dt.date(2021, 1, 2), dt.date(2022, 6, 30), dt.date(2030, 1, 1)]


@pytest.mark.parametrize("impute", ["mean", "none"])
def test_rolling_contexts_equal_single_runs(spark, impute):
    series = spark.createDataFrame(walk(4) + [("d", D(2022, 1, 1), NAN), ("d", D(2022, 7, 1), 5.0)], SERIES).repartition(4)
    got = backtest.rolling_contexts(series, CUTS, 64, impute=impute)
    assert no_window_over_a_series(got)
    plain = lambda rows: sorted(((r.ticker, str(r.origin), r.last_ts, r.n_raw, r.n_padded, [None if x is None else pytest.approx(x, nan_ok=True) for x in r.context]) for r in rows), key=lambda r: r[:2])
    want = []
    for c in CUTS:
        at = F.lit(str(c)).cast("timestamp_ntz")
        want += contexts(series.where(F.col("ts") < at), 64, impute).withColumn("origin", at).collect()
    assert plain(got.collect()) == plain(want) and len(want) > 12


def test_rolling_forecasts_equal_single_runs(spark):
    series = spark.createDataFrame([r for r in walk(5) if good(r[2])], SERIES)
    cfg = ForecastConfig(context_length=32, horizon=5)
    got = sorted(map(tuple, backtest.rolling_forecasts(series, CUTS[1:3], cfg).drop("forecast_ts").collect()))
    want = []
    for c in CUTS[1:3]:
        at = D(c.year, c.month, c.day, getattr(c, "hour", 0))
        bars = series.where(F.col("ts") < F.lit(str(at)).cast("timestamp_ntz")).withColumnRenamed("value", "close")
        want += [(r.ticker, at, r.step, pytest.approx(r.forecast_value)) for r in forecast(bars, cfg).collect()]
    assert got == sorted(want, key=lambda r: r[:3])
    with pytest.raises(ValueError, match="cut-off"):
        backtest.rolling_contexts(series, [], 32)
    errors = backtest.rolling_errors(backtest.rolling_forecasts(series, CUTS, cfg), series)
    assert backtest.error_scores(errors, "ticker").where("mae_score < abs(bias) OR rmse < mae_score - 1e-9").count() == 0


def steps(spark, n=1):
    series = spark.createDataFrame([(f"t{k}", D(2024, 1, 1) + dt.timedelta(days=i), 100.0 + k + (i * 7 % 5)) for k in range(n) for i in range(40)], SERIES)
    return series, ForecastConfig(context_length=32, horizon=3, seed="5")


def test_sketches_are_near_exact_quantiles_and_merge(spark):
    series, cfg = steps(spark)
    drawn = intervals.paths(contexts(series, 32), cfg, 4000).cache()
    assert drawn.select("forecast_value").distinct().count() > 11_900
    exact = {(r.step, r.level): r.forecast_value for r in intervals.path_intervals(drawn, [0.1, 0.5, 0.9], exact=True).collect()}
    for r in intervals.path_intervals(drawn.repartition(7), [0.1, 0.5, 0.9]).collect():
        values = np.sort([x.forecast_value for x in drawn.where(F.col("step") == r.step).collect()])
        assert abs(np.searchsorted(values, r.forecast_value) / len(values) - r.level) < 0.03
        assert abs(r.forecast_value - exact[r.step, r.level]) < 0.05
    halves = intervals.sketches(drawn, ("step", "path")).groupBy("step").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    for r in halves.select("step", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("q"), F.kll_sketch_get_n_double("sketch").alias("n")).collect():
        assert r.n == 4000 and abs(r.q - exact[r.step, 0.5]) < 0.05


def test_paths_do_not_follow_partitions_and_levels_are_checked(spark):
    series, cfg = steps(spark, 3)
    a, b = (sorted(map(tuple, intervals.paths(contexts(series, 32).repartition(n), cfg, 20).collect())) for n in (1, 5))
    assert a == b and len({r[-1] for r in a}) == len(a) == 3 * 20 * 3
    for bad in ([], [0.5, 0.1], [0.0, 0.5], [0.5, 0.5], [1.0]):
        with pytest.raises(ValueError, match="levels"):
            intervals.checked(bad)
    with pytest.raises(ValueError, match="paths"):
        intervals.paths(contexts(series, 32), cfg, 0)


def test_interval_scores(spark):
    made = spark.createDataFrame([("A", s, D(2024, 2, s), q, 10.0 + 5 * (q - 0.5)) for s in range(1, 6) for q in (0.1, 0.5, 0.9)], "ticker string, step int, forecast_ts timestamp_ntz, level double, forecast_value double")
    real = [("A", D(2024, 2, 1), 8.0), ("A", D(2024, 2, 2), 12.0), ("A", D(2024, 2, 3), 13.0), ("A", D(2024, 2, 4), NAN), ("B", D(2024, 2, 5), 1.0)]
    got = {r.level: r for r in intervals.interval_scores(made, spark.createDataFrame(real, SERIES)).collect()}
    assert {k: r.n_matched for k, r in got.items()} == {0.1: 3, 0.5: 3, 0.9: 3}
    assert got[0.1].pinball == pytest.approx((0.1 * 0 + 0.1 * 4 + 0.1 * 5) / 3) and got[0.1].below == pytest.approx(1 / 3)
    assert got[0.9].pinball == pytest.approx((0.1 * 4 + 0 + 0.9 * 1) / 3) and got[0.9].below == pytest.approx(2 / 3)
    c = intervals.coverage(made, spark.createDataFrame(real, SERIES), 0.1, 0.9).first()
    assert (c.coverage, c.width, c.n_matched) == (pytest.approx(2 / 3), pytest.approx(4.0), 3)


def test_model_quantiles_are_kept(spark):
    series, cfg = steps(spark, 2)
    for style in ("quantile_model", "quantile_model_with_mean"):
        own = ForecastConfig(context_length=32, horizon=3, forecaster="pretrained", options={"loader": f"tests.models:{style}"})
        got = sorted(map(tuple, intervals.forecast_intervals(series, own, [0.1, 0.9]).select("ticker", "step", "level", "forecast_value").collect()))
        assert got == [(f"t{k}", s, q, pytest.approx(100.0 + k + 39 * 7 % 5 + s * q)) for k in range(2) for s in (1, 2, 3) for q in (0.1, 0.9)]
    plain = ForecastConfig(context_length=32, horizon=3, forecaster="pretrained", options={"loader": "strandline.plans.queries:last_value_model"})
    with pytest.raises(Exception, match="no quantiles"):
        intervals.forecast_intervals(series, plain, [0.5]).collect()
