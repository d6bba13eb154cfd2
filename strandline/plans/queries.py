"""Named queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import datetime
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import ForecastConfig
from strandline.functions import calendars, series
from strandline.operators import context, evaluate, export, history
from strandline.plans.pipeline import forecast, prepared
from strandline.sources import bars
from strandline.storage import shared_dir

FLAGSHIP = ForecastConfig(context_length=64, horizon=7)
NO_NOISE = ForecastConfig(context_length=64, horizon=20)
NOISY = ForecastConfig(context_length=64, horizon=20, noise=True, seed="7")
WALK = ForecastConfig(context_length=64, horizon=20, forecaster="geometric")
SAVED_AT = "2024-01-01 00:00:00"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return bars.resample(_table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", "1d")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return bars.resample(_table(spark, sf, "events"), "event_type", "ts", "value", "event_id", "1h")


def volumes(spark: SparkSession, sf: str) -> DataFrame:
    ticker = F.concat_ws("-", "l_returnflag", "l_linestatus").alias("ticker")
    return _table(spark, sf, "lineitem").groupBy(ticker, F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts")).agg(F.round(F.sum("l_quantity"), 6).alias("volume"))


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Closes by day, missing where the day's last order key is divisible by 17."""
    at = F.struct("o_orderdate", "o_orderkey")
    key = F.max_by("o_orderkey", at)
    return _table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("ticker"), bars.bar_start(F.col("o_orderdate"), "1d").alias("ts")).agg(F.when(key % 17 != 0, F.max_by("o_totalprice", at)).alias("value"))


def close(spark: SparkSession, sf: str) -> DataFrame:
    return context.target_of(daily(spark, sf), "close")


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _dates(make):
    """A calendar over the last hour of each event type: half past it, so that steps cross midnight and month ends."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        last = _table(spark, sf, "events").groupBy(F.col("event_type").alias("ticker")).agg(F.max("ts").alias("last_ts"))
        return last.select("ticker", F.posexplode(make("last_ts")).alias("step", "forecast_ts")).withColumn("step", F.col("step") + 1)

    return query


def _context_long(spark: SparkSession, sf: str) -> DataFrame:
    ctx = context.contexts(context.target_of(hourly(spark, sf), "close"), 1056)
    return ctx.select("ticker", "n_raw", "n_padded", F.posexplode("context").alias("pos", "value"))


def _context_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("context")
    stats = prepared(daily(spark, sf), FLAGSHIP).select("ticker", "last_ts", c[0].alias("first_value"), F.element_at(c, -1).alias("last_value"), series.stddev_pop_of(c).alias("stddev"))
    return _r(stats, "stddev")


def _forecast(cfg: ForecastConfig):
    return lambda s, d: _r(forecast(daily(s, d), cfg), "forecast_value")


def _ticks(interval: str):
    """Bars of events at an interval."""
    return lambda s, d: bars.resample(_table(s, d, "events"), "event_type", "ts", "value", "event_id", interval)


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars as a frame with a column for each field and ticker, read back."""
    fields = ("open", "high", "low", "close", "volume")
    every = daily(spark, sf)
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = every.groupBy("ts").pivot("ticker", names).agg(*[F.first(f).alias(f) for f in fields])
    return bars.from_wide(wide, "ts", {(f, t): f"{t}_{f}" for f in fields for t in names})


def _records(spark: SparkSession, sf: str, cfg: ForecastConfig = FLAGSHIP) -> DataFrame:
    settings = {"interval": cfg.interval, "context_length": 60, "effective_context_length": cfg.effective_context_length, "horizon_length": cfg.horizon, "model_repo": "drift", "period": "max", "target": cfg.target}
    made = history.run_records(forecast(daily(spark, sf), cfg), settings, daily(spark, sf)).withColumn("timestamp", F.lit(SAVED_AT).cast("timestamp"))
    return history.numbered(history.validated(made), 0)


def _run_record(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("id", "ticker", "interval", "context_length", "horizon_length", "model_repo", "period", F.round(F.element_at("forecast_data", 1), 6).alias("first_step"), F.size("forecast_data").alias("n_steps"))


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Bars up to 30 days before each ticker's last to forecast from, and all closes to score against."""
    every = daily(spark, sf)
    cut = every.groupBy("ticker").agg((F.max("ts") - F.expr("interval 30 days")).alias("_cut"))
    return every.join(cut, "ticker").where(F.col("ts") < F.col("_cut")).drop("_cut"), context.target_of(every, "close")


def _past_records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Runs forecast from all but the last 30 days, and all closes."""
    past, real = _split(spark, sf)
    settings = {"interval": "1d", "context_length": 64, "horizon_length": 20, "model_repo": "drift", "period": "max", "target": "close"}
    return history.numbered(history.validated(history.run_records(forecast(past, NO_NOISE), settings, past)), 0), real


def _stored_history(spark: SparkSession, sf: str) -> DataFrame:
    """Runs saved, one deleted, saved again, scored and read back."""
    folder = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    records, real = _past_records(spark, sf)
    records = records.drop("id")
    history.save_runs(spark, f"{folder}/a", records)
    history.delete_runs(spark, f"{folder}/a", f"{folder}/b", spark.createDataFrame([(5,)], "id bigint"))
    history.save_runs(spark, f"{folder}/b", records.where("ticker = '2-HIGH'"))
    history.score_runs(spark, f"{folder}/b", f"{folder}/c", real)
    return history.read_runs(spark, f"{folder}/c").select("id", "ticker", "last_ts", F.round("mae_score", 6).alias("mae_score"), F.size("forecast_data").alias("n_steps"))


def _backtest(spark: SparkSession, sf: str) -> DataFrame:
    past, real = _split(spark, sf)
    return _r(evaluate.mae(forecast(past, NO_NOISE), real), "mae_score")


def last_value_model(repo, backend, context_length, horizon, options):
    """A stand-in for a pretrained model, to run the adapter: repeats the last value."""
    return lambda arrays: [(np.full((1, horizon), a[-1], "float32"), None) for a in arrays]


PLUGIN = ForecastConfig(context_length=64, horizon=7, forecaster="pretrained", options={"loader": "strandline.plans.queries:last_value_model"})

QUERIES = {
    "bars_daily_ohlcv": daily,
    "bars_hourly_ohlcv": hourly,
    **{f"bars_{i}": _ticks(i) for i in ("1m", "5m", "15m", "30m", "1wk", "1mo")},
    "bars_from_wide": _wide,
    "bars_daily_volume": volumes,
    "select_date_range": lambda s, d: bars.select_range(daily(s, d), datetime.date(1996, 1, 1), datetime.date(1996, 7, 1)),
    "select_default_range": lambda s, d: bars.require_rows(bars.select_range(daily(s, d), *bars.default_range(datetime.date(1996, 7, 1)))),
    "select_period": lambda s, d: bars.select_period(daily(s, d), "1y"),
    "target_projection": lambda s, d: context.target_of(daily(s, d), "volume"),
    "normalize_ticker": lambda s, d: _table(s, d, "customer").select("c_custkey", series.normalize_ticker(F.concat(F.lit("\t "), F.lower("c_mktsegment"), F.lit(" \n"))).alias("ticker")),
    "missing_summary": lambda s, d: context.missing_summary(gappy(s, d)),
    "impute_mean": lambda s, d: _r(context.impute_mean(gappy(s, d)), "value"),
    "context_length_rounding": lambda s, d: _table(s, d, "part").select("p_partkey", series.rounded_context(F.col("p_partkey")).alias("context_length")),
    "context_last_n": lambda s, d: context.last_n(close(s, d), 64),
    "context_padded": _context_long,
    "context_stats": _context_stats,
    "calendar_business": _dates(lambda t: calendars.future(t, "1d", 30)),
    "calendar_step_minutes": _dates(lambda t: calendars.future(t, "15m", 30)),
    "calendar_step_1m": _dates(lambda t: calendars.future(t, "1m", 30)),
    "calendar_step_5m": _dates(lambda t: calendars.future(t, "5m", 30)),
    "calendar_step_30m": _dates(lambda t: calendars.future(t, "30m", 30)),
    "calendar_step_hour": _dates(lambda t: calendars.future(t, "1h", 30)),
    "calendar_step_week": _dates(lambda t: calendars.future(t, "1wk", 30)),
    "calendar_step_month": _dates(lambda t: calendars.future(t, "1mo", 30)),
    "calendar_anchor_week": _dates(lambda t: calendars.future(t, "1wk", 30, "anchored")),
    "calendar_anchor_month": _dates(lambda t: calendars.future(t, "1mo", 30, "anchored")),
    "forecast_drift_mean": _forecast(FLAGSHIP),
    "forecast_geometric_mean": _forecast(WALK),
    "forecast_drift_seeded": _forecast(NOISY),
    "forecast_geometric_seeded": _forecast(ForecastConfig(context_length=64, horizon=20, forecaster="geometric", noise=True, seed="7")),
    "plot_frame": lambda s, d: _r(evaluate.plot_frame(close(s, d), forecast(daily(s, d), FLAGSHIP)), "value"),
    "export_rows": lambda s, d: _r(export.export_rows(forecast(daily(s, d).where("ticker = '1-URGENT'"), FLAGSHIP)), "Forecast_Value"),
    "run_record": _run_record,
    "history_newest_first": lambda s, d: history.history_grid(_records(s, d)).select("id", "ticker", "interval", "context_length", "horizon_length", "model_repo", "period", "mae_score"),
    "backtest_mae": _backtest,
    "overlay_run": lambda s, d: _r(history.overlay(_records(s, d), [1, 3]), "value"),
    "overlay_with_actuals": lambda s, d: _r(history.overlay(_records(s, d), [2], close(s, d)), "value"),
    "run_last_ts": lambda s, d: _records(s, d).select("id", "ticker", "last_ts"),
    "run_mae": lambda s, d: _r(history.scored_runs(*_past_records(s, d)).select("id", "ticker", "mae_score"), "mae_score"),
    "history_stored": _stored_history,
    "delete_run": lambda s, d: history.without_runs(_records(s, d), s.createDataFrame([(2,)], "id bigint")).select("id", "ticker"),
    "model_plugin_forecast": _forecast(PLUGIN),
}

_BARS = """bars AS (SELECT o_orderpriority AS ticker, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts,
  arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*) AS volume
  FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1, 2)"""
_HOURS = """bars AS (SELECT event_type AS ticker, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
  arg_min(value, (events.ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (events.ts, event_id)) AS close, count(*) AS volume
  FROM events WHERE event_type IS NOT NULL AND events.ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)"""
_GAPPY = """gappy AS (SELECT o_orderpriority AS ticker, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts,
  CASE WHEN arg_max(o_orderkey, (o_orderdate, o_orderkey)) % 17 <> 0 THEN arg_max(o_totalprice, (o_orderdate, o_orderkey)) END AS value
  FROM orders GROUP BY 1, 2)"""


def _tick_bars(start: str) -> str:
    return f"""SELECT event_type AS ticker, CAST({start} AS TIMESTAMP) AS ts, arg_min(value, (events.ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (events.ts, event_id)) AS close, count(*) AS volume FROM events WHERE event_type IS NOT NULL AND events.ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2"""


def _ctx(n: int, source: str = "bars") -> str:
    """ctx: ticker, last_ts, c (the padded context as a list)."""
    return f"""lastn AS (SELECT ticker, ts, close AS value, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS k FROM {source}),
  raw AS (SELECT ticker, max(ts) AS last_ts, list(value ORDER BY ts) AS v FROM lastn WHERE k <= {n} GROUP BY 1),
  ctx AS (SELECT ticker, last_ts, len(v) AS n_raw, {n} - len(v) AS n_padded,
    list_concat(list_transform(range({n} - len(v)), lambda i: v[1]), v) AS c FROM raw)"""


def _business(h: int, source: str) -> str:
    """cal: ticker, step, forecast_ts on Mondays to Fridays after last_ts."""
    return f"""cal AS (SELECT ticker, step, forecast_ts FROM (SELECT ticker, CAST(d AS TIMESTAMP) AS forecast_ts, row_number() OVER (PARTITION BY ticker ORDER BY d) AS step
    FROM (SELECT ticker, unnest(generate_series(CAST(CAST(last_ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY, CAST(CAST(last_ts AS DATE) AS TIMESTAMP) + INTERVAL {h * 2 + 14} DAY, INTERVAL 1 DAY)) AS d FROM {source})
    WHERE isodow(d) < 6) WHERE step <= {h})"""


def _uniform(tag: str, seed: str = "7") -> str:
    return f"((('0x' || substr(md5(concat_ws('|', ticker, CAST(step AS VARCHAR), '{seed}', '{tag}')), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"


_NORMAL = f"(sqrt(-2.0 * ln({_uniform('a')})) * cos(6.283185307179586::DOUBLE * {_uniform('b')}))"


def _drift(h: int, noise: str = "0.0", source: str = "bars") -> str:
    return f"""{_ctx(64, source)}, {_business(h, "ctx")},
  sd AS (SELECT ticker, stddev_pop(x) AS sd FROM (SELECT ticker, unnest(c) AS x FROM ctx) GROUP BY 1),
  fc AS (SELECT cal.ticker, step, forecast_ts, c[64] + (c[64] - c[1]) / 64 * step + {noise} AS forecast_value FROM cal JOIN ctx ON cal.ticker = ctx.ticker JOIN sd ON cal.ticker = sd.ticker)"""


def _walk(h: int, noise: str = "0.0") -> str:
    grown = "forecast_value * (1.0 + (0.001 + 0.015 * " + noise.replace("step", "(step + 1)") + "))"
    return f"""{_ctx(64)}, {_business(h, "ctx")},
  walk(ticker, step, forecast_value) AS (SELECT ticker, 0::BIGINT, c[64]::DOUBLE FROM ctx UNION ALL SELECT ticker, step + 1, {grown} FROM walk WHERE step < {h}),
  fc AS (SELECT walk.ticker, walk.step, forecast_ts, forecast_value FROM walk JOIN cal ON walk.ticker = cal.ticker AND walk.step = cal.step)"""


_FC = "SELECT ticker, step, forecast_ts, round(forecast_value, 6) AS forecast_value FROM fc"
_LAST = "last AS (SELECT event_type AS ticker, max(ts) AS last_ts FROM events GROUP BY 1)"


def _steps(expr: str) -> str:
    return f"WITH {_LAST} SELECT ticker, i AS step, CAST({expr} AS TIMESTAMP) AS forecast_ts FROM last, range(1, 31) AS r(i)"


_RUNS = f"WITH {_BARS}, {_drift(7)}, ids AS (SELECT ticker, row_number() OVER (ORDER BY ticker) AS id FROM ctx)"
_PAST = f"WITH {_BARS}, past AS (SELECT bars.* FROM bars JOIN (SELECT ticker, max(ts) AS m FROM bars GROUP BY 1) USING (ticker) WHERE ts < m - INTERVAL 30 DAY), {_drift(20, source='past')}"
_SCORES = """scores AS (SELECT row_number() OVER (ORDER BY ticker) AS id, ticker, last_ts, mae_score FROM ctx LEFT JOIN
  (SELECT fc.ticker, round(avg(abs(forecast_value - close)), 6) AS mae_score FROM fc JOIN bars ON fc.ticker = bars.ticker AND fc.forecast_ts = bars.ts GROUP BY 1) USING (ticker))"""
_GRID = "id, ticker, '1d' AS interval, 60 AS context_length, 7 AS horizon_length, 'drift' AS model_repo, 'max' AS period"
_U = "(last_ts + INTERVAL 1 HOUR)"

ORACLE = {
    "bars_daily_ohlcv": f"WITH {_BARS} SELECT * FROM bars",
    "bars_hourly_ohlcv": f"WITH {_HOURS} SELECT * FROM bars",
    **{f"bars_{n}m": _tick_bars(f"time_bucket(INTERVAL {n} MINUTE, events.ts)") for n in (1, 5, 15, 30)},
    "bars_1wk": _tick_bars("date_trunc('week', events.ts)"),
    "bars_1mo": _tick_bars("date_trunc('month', events.ts)"),
    "bars_from_wide": f"WITH {_BARS} SELECT * FROM bars",
    "bars_daily_volume": "SELECT l_returnflag || '-' || l_linestatus AS ticker, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, round(sum(l_quantity), 6) AS volume FROM lineitem GROUP BY 1, 2",
    "select_date_range": f"WITH {_BARS} SELECT * FROM bars WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1996-07-01'",
    "select_default_range": f"WITH {_BARS} SELECT * FROM bars WHERE ts >= TIMESTAMP '1996-07-01' - INTERVAL 365 DAY AND ts < TIMESTAMP '1996-07-01'",
    "select_period": f"WITH {_BARS}, last AS (SELECT ticker, max(ts) AS m FROM bars GROUP BY 1) SELECT bars.* FROM bars JOIN last USING (ticker) WHERE ts > m - INTERVAL 12 MONTH",
    "target_projection": f"WITH {_BARS} SELECT ticker, ts, CAST(volume AS DOUBLE) AS value FROM bars",
    "normalize_ticker": "SELECT c_custkey, upper(c_mktsegment) AS ticker FROM customer",
    "missing_summary": f"WITH {_GAPPY} SELECT ticker, count(*) AS n_rows, count(*) - count(value) AS n_missing, count(value) = 0 AS all_missing FROM gappy GROUP BY 1",
    "impute_mean": f"WITH {_GAPPY}, m AS (SELECT ticker, avg(value) AS mean FROM gappy GROUP BY 1) SELECT ticker, ts, round(coalesce(value, mean), 6) AS value FROM gappy JOIN m USING (ticker) WHERE mean IS NOT NULL",
    "context_length_rounding": "SELECT p_partkey, CAST(ceil(p_partkey / 32.0) AS BIGINT) * 32 AS context_length FROM part",
    "context_last_n": f"WITH {_BARS} SELECT ticker, ts, close AS value FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) <= 64",
    "context_padded": f"WITH {_HOURS}, {_ctx(1056)} SELECT ticker, n_raw, n_padded, i AS pos, c[i + 1] AS value FROM ctx, range(1056) AS r(i)",
    "context_stats": f"WITH {_BARS}, {_ctx(64)} SELECT ticker, any_value(last_ts) AS last_ts, any_value(c[1]) AS first_value, any_value(c[64]) AS last_value, round(stddev_pop(x), 6) AS stddev FROM (SELECT *, unnest(c) AS x FROM ctx) GROUP BY 1",
    "calendar_business": f"WITH {_LAST}, {_business(30, 'last')} SELECT ticker, step, forecast_ts FROM cal",
    "calendar_step_minutes": _steps("last_ts + to_minutes(15 * i)"),
    "calendar_step_1m": _steps("last_ts + to_minutes(i)"),
    "calendar_step_5m": _steps("last_ts + to_minutes(5 * i)"),
    "calendar_step_30m": _steps("last_ts + to_minutes(30 * i)"),
    "calendar_step_hour": _steps("last_ts + to_hours(i)"),
    "calendar_step_week": _steps("last_ts + to_days(CAST(7 * i AS INTEGER))"),
    "calendar_step_month": _steps("last_ts + to_months(CAST(i AS INTEGER))"),
    "calendar_anchor_week": _steps(f"{_U} + to_days(CAST((7 - isodow({_U})) + 7 * (i - 1) AS INTEGER))"),
    "calendar_anchor_month": _steps(f"CAST(last_day(CAST(date_trunc('month', {_U}) AS TIMESTAMP) + to_months(CAST(i - 1 AS INTEGER))) AS TIMESTAMP) + ({_U} - CAST(date_trunc('day', {_U}) AS TIMESTAMP))"),
    "forecast_drift_mean": f"WITH {_BARS}, {_drift(7)} {_FC}",
    "forecast_geometric_mean": f"WITH RECURSIVE {_BARS}, {_walk(20)} {_FC}",
    "forecast_drift_seeded": f"WITH {_BARS}, {_drift(20, '0.1 * sd * ' + _NORMAL.replace('ticker', 'cal.ticker'))} {_FC}",
    "forecast_geometric_seeded": f"WITH RECURSIVE {_BARS}, {_walk(20, _NORMAL)} {_FC}",
    "plot_frame": f"WITH {_BARS}, {_drift(7)} SELECT ticker, ts, 'history' AS series, round(close, 6) AS value FROM bars UNION ALL SELECT ticker, last_ts, 'forecast', round(c[64], 6) FROM ctx UNION ALL SELECT ticker, forecast_ts, 'forecast', round(forecast_value, 6) FROM fc",
    "export_rows": f"WITH {_BARS}, {_drift(7)} SELECT 'Forecast' AS Type, step AS Step, round(forecast_value, 6) AS Forecast_Value FROM fc WHERE ticker = '1-URGENT'",
    "run_record": f"{_RUNS} SELECT {_GRID}, round(forecast_value, 6) AS first_step, 7 AS n_steps FROM fc JOIN ids USING (ticker) WHERE step = 1",
    "history_newest_first": f"{_RUNS} SELECT {_GRID}, CAST(NULL AS DOUBLE) AS mae_score FROM ids ORDER BY id DESC",
    "backtest_mae": f"{_PAST} SELECT fc.ticker, round(avg(abs(forecast_value - close)), 6) AS mae_score, count(*) AS n_matched FROM fc JOIN bars ON fc.ticker = bars.ticker AND fc.forecast_ts = bars.ts GROUP BY 1",
    "overlay_run": f"{_RUNS} SELECT id, ticker, step, forecast_ts AS ts, round(forecast_value, 6) AS value FROM fc JOIN ids USING (ticker) WHERE id IN (1, 3)",
    "overlay_with_actuals": f"{_RUNS} SELECT id, ticker, step, forecast_ts AS ts, round(forecast_value, 6) AS value FROM fc JOIN ids USING (ticker) WHERE id = 2 UNION ALL SELECT NULL, ticker, NULL, ts, round(close, 6) FROM bars WHERE ticker = (SELECT ticker FROM ids WHERE id = 2)",
    "run_last_ts": f"{_RUNS} SELECT id, ticker, last_ts FROM ids JOIN ctx USING (ticker)",
    "run_mae": f"{_PAST}, {_SCORES} SELECT id, ticker, mae_score FROM scores",
    "history_stored": f"{_PAST}, {_SCORES} SELECT id, ticker, last_ts, mae_score, 20 AS n_steps FROM scores WHERE id <> 5 UNION ALL SELECT 6, ticker, last_ts, mae_score, 20 FROM scores WHERE ticker = '2-HIGH'",
    "delete_run": f"{_RUNS} SELECT id, ticker FROM ids WHERE id <> 2",
    "model_plugin_forecast": f"WITH {_BARS}, {_ctx(64)}, {_business(7, 'ctx')} SELECT cal.ticker, step, forecast_ts, round(CAST(CAST(c[64] AS FLOAT) AS DOUBLE), 6) AS forecast_value FROM cal JOIN ctx ON cal.ticker = ctx.ticker",
}
