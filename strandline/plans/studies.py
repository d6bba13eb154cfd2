"""Named queries that study series: backtests, matches in time, gaps, intervals; and the same in DuckDB's SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import ForecastConfig
from strandline.functions import sql
from strandline.operators import backtest, calendar, context, downsample, gaps, intervals, ranges, sessions
from strandline.plans import queries as q
from strandline.plans.pipeline import forecast

MONTHS = [datetime.date(1993 + m // 12, m % 12 + 1, 1) for m in range(66)]
LEVELS = [0.1, 0.5, 0.9]
PATHS = ForecastConfig(context_length=64, horizon=20, noise=True, seed="7")
ROLLING = ForecastConfig(context_length=64, horizon=10)


def _rolling(spark: SparkSession, sf: str) -> DataFrame:
    closes = q.close(spark, sf)
    errors = backtest.rolling_errors(backtest.rolling_forecasts(closes, MONTHS, ROLLING), closes)
    return q._r(backtest.error_scores(errors, "origin", "step"), "mae_score", "bias", "rmse")


def _rolling_contexts(spark: SparkSession, sf: str) -> DataFrame:
    made = backtest.rolling_contexts(q.gappy(spark, sf), MONTHS, 64)
    mean = F.aggregate("context", F.lit(0.0), lambda a, x: a + x) / 64
    return made.select("ticker", "origin", "last_ts", "n_raw", "n_padded", F.round(mean, 4).alias("mean_value"), F.round(F.element_at("context", -1), 4).alias("last_value"))


def _as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of the last 30 days, each with the latest close at or before it, not older than three days."""
    past, real = q._split(spark, sf)
    made = forecast(past, q.NO_NOISE)
    return q._r(ranges.as_of(made, real, ["ticker"], "forecast_ts", "ts", ["value"], "3 days", "month"), "forecast_value")


def _as_of_mae(spark: SparkSession, sf: str) -> DataFrame:
    met = _as_of(spark, sf).where("value IS NOT NULL").withColumn("error", F.col("forecast_value") - F.col("value"))
    return q._r(backtest.error_scores(met, "ticker"), "mae_score", "bias", "rmse")


def _linear(spark: SparkSession, sf: str) -> DataFrame:
    closes = q.hourly(spark, sf).select("ticker", "ts", F.col("close").alias("value"))
    return q._r(gaps.fill_series(closes, "1h", "linear"), "value")


def _past_intervals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Quantiles of 25 paths from all but the last 30 days, and all closes."""
    past, real = q._split(spark, sf)
    return intervals.forecast_intervals(context.target_of(past, "close"), PATHS, LEVELS, 25, True), real


def _score_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of two targets at three cut-offs, by ticker, target and step, with subtotals."""
    every = []
    for target in ("close", "volume"):
        series = context.target_of(q.daily(spark, sf), target)
        made = backtest.rolling_forecasts(series, MONTHS[12:48:12], ROLLING)
        every.append(backtest.rolling_errors(made, series).select("ticker", F.lit(target).alias("target"), "step", "error"))
    return q._r(backtest.level_scores(every[0].unionByName(every[1]), ["ticker", "target", "step"]), "mae_score", "bias", "rmse")


#: Days without trading in the example calendar, and half days.
CLOSED = [datetime.date(y, m, d) for y in range(1991, 2027) for m, d in ((1, 1), (7, 4), (12, 25))]
HALF = [datetime.date(y, 12, 24) for y in range(1991, 2027)]


def _exchange_days(spark: SparkSession, sf: str) -> DataFrame:
    """The next 260 open days after each order priority's last order."""
    last = q._table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("ticker")).agg(F.max("o_orderdate").alias("last_ts"))
    table = calendar.calendar_table(spark, datetime.date(1991, 1, 1), datetime.date(2026, 12, 31), CLOSED, HALF)
    return calendar.next_open_days(last, table, "last_ts", 260)


def _sql_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship forecast, written as SQL over the table function."""
    sql.register(spark)
    sql.recent_view(spark, q.daily(spark, sf), "recent_daily", context_length=64)
    made = spark.sql("SELECT * FROM forecast_series(TABLE(recent_daily) PARTITION BY ticker ORDER BY ts, horizon => 7, context_length => 64)")
    return q._r(made, "forecast_value")


QUERIES = {
    "sql_forecast": _sql_forecast,
    "sessions": lambda s, d: q._r(sessions.session_bars(q._table(s, d, "events"), "event_type", "ts", "value", "event_id", "90 minutes"), "volume_value"),
    "plot_m4": lambda s, d: downsample.m4(q.close(s, d), 100),
    "scores_by_level": _score_levels,
    "exchange_calendar": _exchange_days,
    "intervals_exact": lambda s, d: q._r(_past_intervals(s, d)[0], "forecast_value"),
    "intervals_pinball": lambda s, d: q._r(intervals.interval_scores(*_past_intervals(s, d), "ticker"), "pinball", "below"),
    "intervals_coverage": lambda s, d: q._r(intervals.coverage(*_past_intervals(s, d), 0.1, 0.9, "ticker"), "coverage", "width"),
    "backtest_rolling": _rolling,
    "backtest_rolling_contexts": _rolling_contexts,
    "as_of_matches": _as_of,
    "as_of_mae": _as_of_mae,
    "gaps_flat_bars": lambda s, d: gaps.fill_bars(q.hourly(s, d), "1h"),
    "gaps_last_value": lambda s, d: gaps.fill_series(q.gappy(s, d), "1d", "last"),
    "gaps_linear": _linear,
}


def _rolling_ctx(source: str, value: str) -> str:
    """ctx: ticker, origin, last_ts, n_raw, c."""
    return f"""cuts AS (SELECT unnest(generate_series(TIMESTAMP '1993-01-01', TIMESTAMP '1998-06-01', INTERVAL 1 MONTH)) AS origin),
  seen AS (SELECT ticker, origin, ts, {value} AS value, row_number() OVER (PARTITION BY ticker, origin ORDER BY ts DESC) AS k, avg({value}) OVER (PARTITION BY ticker, origin) AS mean FROM {source} JOIN cuts ON ts < origin),
  raw AS (SELECT ticker, origin, max(ts) AS last_ts, list(coalesce(value, mean) ORDER BY ts) AS v FROM seen WHERE k <= 64 AND mean IS NOT NULL GROUP BY 1, 2),
  ctx AS (SELECT ticker, origin, last_ts, len(v) AS n_raw, list_concat(list_transform(range(64 - len(v)), lambda i: v[1]), v) AS c FROM raw)"""


_ROLLING = f"""WITH {q._BARS}, {_rolling_ctx("bars", "close")},
  cal AS (SELECT *, row_number() OVER (PARTITION BY ticker, origin ORDER BY forecast_ts) AS step FROM
    (SELECT ticker, origin, c, unnest(generate_series(last_ts + INTERVAL 1 DAY, last_ts + INTERVAL 20 DAY, INTERVAL 1 DAY)) AS forecast_ts FROM ctx) WHERE isodow(forecast_ts) < 6),
  errors AS (SELECT origin, step, c[64] + (c[64] - c[1]) / 64 * step - close AS e FROM cal JOIN bars ON cal.ticker = bars.ticker AND forecast_ts = ts WHERE step <= 10)
  SELECT origin, CAST(step AS INTEGER) AS step, round(avg(abs(e)), 6) AS mae_score, round(avg(e), 6) AS bias, round(sqrt(avg(e * e)), 6) AS rmse, count(*) AS n_matched FROM errors GROUP BY 1, 2"""
_ASOF = f"""{q._PAST}, met AS (SELECT fc.ticker, step, forecast_ts, round(forecast_value, 6) AS forecast_value, bars.ts, close FROM fc ASOF LEFT JOIN bars ON fc.ticker = bars.ticker AND fc.forecast_ts >= bars.ts),
  near AS (SELECT ticker, step, forecast_ts, forecast_value, CASE WHEN ts >= forecast_ts - INTERVAL 3 DAY THEN ts END AS matched_ts, CASE WHEN ts >= forecast_ts - INTERVAL 3 DAY THEN close END AS value FROM met)"""


def _grid(source: str, step: str) -> str:
    """whole: ticker, ts of the grid, with the source's columns."""
    return f"""grid AS (SELECT ticker, unnest(generate_series(a, b, INTERVAL 1 {step})) AS ts FROM (SELECT ticker, min(ts) AS a, max(ts) AS b FROM {source} GROUP BY 1)),
  whole AS (SELECT grid.ticker, grid.ts, {source}.* EXCLUDE (ticker, ts), {source}.ts AS known_ts FROM grid LEFT JOIN {source} ON grid.ticker = {source}.ticker AND grid.ts = {source}.ts)"""


_PATH_NOISE = "0.1 * sd * " + q._NORMAL.replace("'7',", "'7', CAST(path AS VARCHAR),").replace("ticker", "cal.ticker")
_PATHS = f"""{q._PAST.replace("WITH", "WITH", 1).split(", lastn AS")[0]}, {q._drift(20, _PATH_NOISE, "past").replace("forecast_ts, c[64]", "forecast_ts, path, c[64]").replace("FROM cal JOIN ctx", "FROM cal CROSS JOIN range(1, 26) AS p(path) JOIN ctx")},
  quantiles AS (SELECT ticker, step, forecast_ts, level, quantile_cont(forecast_value, [0.1, 0.5, 0.9])[i] AS forecast_value FROM fc, (VALUES (1, 0.1::DOUBLE), (2, 0.5::DOUBLE), (3, 0.9::DOUBLE)) AS l(i, level) GROUP BY ticker, step, forecast_ts, level, i),
  met AS (SELECT quantiles.*, close AS y FROM quantiles JOIN bars ON quantiles.ticker = bars.ticker AND forecast_ts = ts)"""
_BEFORE = "OVER (PARTITION BY ticker ORDER BY ts)"
_AFTER = "OVER (PARTITION BY ticker ORDER BY ts DESC)"

_LEVEL_FC = """{name}_seen AS (SELECT ticker, origin, ts, {column} AS value, row_number() OVER (PARTITION BY ticker, origin ORDER BY ts DESC) AS k FROM bars JOIN cuts ON ts < origin),
  {name}_raw AS (SELECT ticker, origin, max(ts) AS last_ts, list(CAST(value AS DOUBLE) ORDER BY ts) AS v FROM {name}_seen WHERE k <= 64 GROUP BY 1, 2),
  {name}_ctx AS (SELECT ticker, origin, last_ts, list_concat(list_transform(range(64 - len(v)), lambda i: v[1]), v) AS c FROM {name}_raw),
  {name}_cal AS (SELECT *, row_number() OVER (PARTITION BY ticker, origin ORDER BY forecast_ts) AS step FROM
    (SELECT ticker, origin, c, unnest(generate_series(last_ts + INTERVAL 1 DAY, last_ts + INTERVAL 20 DAY, INTERVAL 1 DAY)) AS forecast_ts FROM {name}_ctx) WHERE isodow(forecast_ts) < 6),
  {name}_errors AS (SELECT cal.ticker, '{column}' AS target, CAST(step AS INTEGER) AS step, c[64] + (c[64] - c[1]) / 64 * step - {column} AS e FROM {name}_cal cal JOIN bars ON cal.ticker = bars.ticker AND forecast_ts = ts WHERE step <= 10)"""

ORACLE = {
    "sql_forecast": q.ORACLE["forecast_drift_mean"],
    "sessions": """WITH t AS (SELECT event_type AS ticker, ts, value, event_id, CASE WHEN ts > lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 90 MINUTE OR lag(ts) OVER (PARTITION BY event_type ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new
      FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL), s AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY ts) AS k FROM t)
    SELECT ticker, min(ts) AS ts, max(ts) AS last_ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume, round(sum(value), 6) AS volume_value FROM s GROUP BY ticker, k""",
    "plot_m4": f"""WITH {q._BARS}, ends AS (SELECT ticker, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1),
  placed AS (SELECT bars.ticker, ts, close, CASE WHEN a = b THEN 0 ELSE least(99, CAST(floor((epoch_us(ts) - epoch_us(a))::DOUBLE / (epoch_us(b) - epoch_us(a)) * 100) AS INTEGER)) END AS pixel FROM bars JOIN ends ON bars.ticker = ends.ticker),
  four AS (SELECT ticker, pixel, min(ts) AS t1, arg_min(close, ts) AS v1, max(ts) AS t2, arg_max(close, ts) AS v2, arg_min(ts, (close, ts)) AS t3, min(close) AS v3, arg_min(ts, (-close, ts)) AS t4, max(close) AS v4 FROM placed GROUP BY 1, 2)
  SELECT DISTINCT ticker, pixel, ts, value FROM (SELECT ticker, pixel, t1 AS ts, v1 AS value FROM four UNION ALL SELECT ticker, pixel, t2, v2 FROM four UNION ALL SELECT ticker, pixel, t3, v3 FROM four UNION ALL SELECT ticker, pixel, t4, v4 FROM four)""",
    "scores_by_level": f"""WITH {q._BARS}, cuts AS (SELECT unnest([TIMESTAMP '1994-01-01', TIMESTAMP '1995-01-01', TIMESTAMP '1996-01-01']) AS origin),
  {_LEVEL_FC.format(name="a", column="close")}, {_LEVEL_FC.format(name="b", column="volume")}, every AS (SELECT * FROM a_errors UNION ALL SELECT * FROM b_errors)
  SELECT ticker, target, step, CAST(grouping(ticker, target, step) AS BIGINT) AS grouping_id, round(avg(abs(e)), 6) AS mae_score, round(avg(e), 6) AS bias, round(sqrt(avg(e * e)), 6) AS rmse, count(*) AS n_matched
  FROM every GROUP BY GROUPING SETS ((ticker, target, step), (ticker, target), (target, step), (target))""",
    "exchange_calendar": """WITH days AS (SELECT CAST(d AS DATE) AS day FROM range(TIMESTAMP '1991-01-01', TIMESTAMP '2027-01-01', INTERVAL 1 DAY) AS r(d)),
  open AS (SELECT day, month(day) = 12 AND day(day) = 24 AS half_day FROM days WHERE isodow(day) < 6 AND NOT ((month(day) = 1 AND day(day) = 1) OR (month(day) = 7 AND day(day) = 4) OR (month(day) = 12 AND day(day) = 25))),
  last AS (SELECT o_orderpriority AS ticker, max(o_orderdate) AS last_ts FROM orders GROUP BY 1)
  SELECT ticker, CAST(step AS INTEGER) AS step, CAST(day AS TIMESTAMP) AS forecast_ts, half_day FROM (SELECT ticker, day, half_day, row_number() OVER (PARTITION BY ticker ORDER BY day) AS step FROM last JOIN open ON day > CAST(last_ts AS DATE)) WHERE step <= 260""",
    "intervals_exact": f"{_PATHS} SELECT ticker, CAST(step AS INTEGER) AS step, forecast_ts, level, round(forecast_value, 6) AS forecast_value FROM quantiles",
    "intervals_pinball": f"{_PATHS} SELECT ticker, level, round(avg(greatest(level * (y - forecast_value), (level - 1) * (y - forecast_value))), 6) AS pinball, round(avg(CASE WHEN y <= forecast_value THEN 1.0 ELSE 0.0 END), 6) AS below, count(*) AS n_matched FROM met GROUP BY 1, 2",
    "intervals_coverage": f"""{_PATHS}, pairs AS (SELECT ticker, step, y, max(forecast_value) FILTER (level = 0.1) AS a, max(forecast_value) FILTER (level = 0.9) AS b FROM met GROUP BY 1, 2, 3)
  SELECT ticker, round(avg(CASE WHEN y BETWEEN a AND b THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(b - a), 6) AS width, count(*) AS n_matched FROM pairs GROUP BY 1""",
    "backtest_rolling": _ROLLING,
    "backtest_rolling_contexts": f"WITH {q._GAPPY}, {_rolling_ctx('gappy', 'value')} SELECT ticker, origin, last_ts, n_raw, 64 - n_raw AS n_padded, round(list_sum(c) / 64, 4) AS mean_value, round(c[64], 4) AS last_value FROM ctx",
    "as_of_matches": f"{_ASOF} SELECT * FROM near",
    "as_of_mae": f"{_ASOF} SELECT ticker, round(avg(abs(forecast_value - value)), 6) AS mae_score, round(avg(forecast_value - value), 6) AS bias, round(sqrt(avg((forecast_value - value) * (forecast_value - value))), 6) AS rmse, count(*) AS n_matched FROM near WHERE value IS NOT NULL GROUP BY 1",
    "gaps_flat_bars": f"""WITH {q._HOURS}, {_grid("bars", "HOUR")}, kept AS (SELECT *, last_value(close IGNORE NULLS) {_BEFORE} AS c FROM whole)
  SELECT ticker, ts, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, coalesce(close, c) AS close, coalesce(volume, 0) AS volume, known_ts IS NULL AS filled FROM kept""",
    "gaps_last_value": f"""WITH {q._GAPPY}, known AS (SELECT * FROM gappy WHERE value IS NOT NULL), {_grid("known", "DAY")}
  SELECT ticker, ts, last_value(value IGNORE NULLS) {_BEFORE} AS value, value IS NULL AS filled FROM whole""",
    "gaps_linear": f"""WITH {q._HOURS}, {_grid("bars", "HOUR")}, near AS (SELECT ticker, ts, close, last_value(known_ts IGNORE NULLS) {_BEFORE} AS t0, last_value(close IGNORE NULLS) {_BEFORE} AS v0,
    last_value(known_ts IGNORE NULLS) {_AFTER} AS t1, last_value(close IGNORE NULLS) {_AFTER} AS v1 FROM whole)
  SELECT ticker, ts, round(CASE WHEN close IS NULL THEN v0 + (v1 - v0) * (epoch_us(ts) - epoch_us(t0))::DOUBLE / (epoch_us(t1) - epoch_us(t0)) ELSE close END, 6) AS value, close IS NULL AS filled FROM near""",
}
