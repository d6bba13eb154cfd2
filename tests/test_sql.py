"""The table function against the same forecasts made of DataFrames; arguments that analysis refuses."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline import ForecastConfig, forecast
from strandline.functions import calendars, sql
from strandline.functions.series import drawn_normal, hashed_normal

D = dt.datetime
NAN = float("nan")


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(f"t{k}", D(2024, 1, 1) + dt.timedelta(days=i), NAN if i % 11 == 3 else None if i % 13 == 5 else 50.0 + k + (i * 7 % 5), i) for k in range(3) for i in range(20 + 60 * k)]
    df = spark.createDataFrame(rows + [("none", D(2024, 1, 1), NAN, 1), ("one", D(2024, 1, 31), 3.0, 1)], "ticker string, ts timestamp_ntz, close double, volume bigint").repartition(3)
    df.createOrReplaceTempView("bars")
    sql.register(spark)
    return df


def rows(df):
    return sorted((r.ticker, r.step, r.forecast_ts, pytest.approx(r.forecast_value, rel=1e-12)) for r in df.collect())


@pytest.mark.parametrize("more", [{}, {"forecaster": "geometric"}, {"noise": True, "seed": "x"}, {"forecaster": "geometric", "noise": True}, {"interval": "1mo", "calendar": "anchored"}, {"interval": "1h", "target": "volume"}])
def test_sql_equals_dataframes(spark, bars, more):
    args = "".join(f", {k} => {str(v).lower() if isinstance(v, bool) else repr(v)}" for k, v in more.items())
    want = rows(forecast(bars, ForecastConfig(context_length=33, horizon=6, **more)))
    got = spark.sql(f"SELECT * FROM forecast_series(TABLE(bars) PARTITION BY ticker ORDER BY ts, horizon => 6, context_length => 33{args})")
    assert got.dtypes == [("ticker", "string"), ("step", "int"), ("forecast_ts", "timestamp_ntz"), ("forecast_value", "double")]
    assert rows(got) == want and len(want) in (24, 30)
    target = more.get("target", "close")
    sql.recent_view(spark, bars, "recent", target, 33)
    assert rows(spark.sql(f"SELECT * FROM forecast_series(TABLE(recent) PARTITION BY ticker ORDER BY ts, horizon => 6, context_length => 33{args})")) == want
    plan = spark.table("recent")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_sql_pretrained(spark, bars):
    got = spark.sql("SELECT * FROM forecast_series(TABLE(bars) PARTITION BY ticker ORDER BY ts, horizon => 2, context_length => 32, forecaster => 'pretrained', loader => 'strandline.plans.queries:last_value_model')").collect()
    assert {(r.ticker, r.forecast_value) for r in got if r.ticker == "one"} == {("one", 3.0)} and len(got) == 8


@pytest.mark.parametrize("args,what", [
    ("horizon => 0", "horizon must be at least 1"), ("horizon => '7'", "constant int"), ("horizon => true", "constant int"), ("context_length => -1", "at least 1"), ("forecaster => 'magic'", "forecaster must be"),
    ("target => 'open'", "no column open"), ("target => 'x'", "target must be"), ("interval => '2d'", "interval must be"), ("horizn => 3", "no argument horizn"), ("forecaster => 'pretrained'", "no forecasting model"), ("seed => cast(rand() as string)", "constant str"),
])
def test_wrong_arguments_fail_at_analysis(spark, bars, args, what):
    with pytest.raises(Exception, match=what):
        spark.sql(f"SELECT * FROM forecast_series(TABLE(bars) PARTITION BY ticker ORDER BY ts, {args})")  # not collected


def test_wrong_tables_fail_at_analysis(spark, bars):
    for table, what in (("SELECT ticker, close FROM bars", "no column ts"), ("SELECT ticker, 'a' AS ts, close FROM bars", "ts must be"), ("SELECT ticker, ts, 'a' AS close FROM bars", "must be a number")):
        with pytest.raises(Exception, match=what):
            spark.sql(f"SELECT * FROM forecast_series(TABLE({table}) PARTITION BY ticker)")
    with pytest.raises(Exception, match="must be a table"):
        spark.sql("SELECT * FROM forecast_series(1)")
    assert spark.sql("SELECT * FROM forecast_series(TABLE(SELECT * FROM bars WHERE false) PARTITION BY ticker ORDER BY ts)").collect() == []


@pytest.mark.parametrize("interval,policy", [(i, "step") for i in ("1m", "5m", "15m", "30m", "1h", "1d", "1wk", "1mo")] + [("1wk", "anchored"), ("1mo", "anchored")])
def test_python_calendars_equal_columns(spark, interval, policy):
    starts = [D(2024, 1, 5, 15, 30), D(2024, 1, 6), D(2024, 1, 7), D(2024, 1, 31, 23, 30), D(2023, 12, 31), D(2024, 2, 29, 23, 59)]
    got = spark.createDataFrame([(s,) for s in starts], "t timestamp_ntz").select("t", calendars.future("t", interval, 40, policy).alias("f")).collect()
    assert all(calendars.listed(r.t, interval, 40, policy) == r.f for r in got)


def test_python_noise_equals_columns(spark):
    df = spark.range(50).select("id", hashed_normal(F.lit("t"), F.col("id"), F.lit("s")).alias("x"))
    assert all(drawn_normal("t", r.id, "s") == pytest.approx(r.x, rel=1e-12) for r in df.collect())
