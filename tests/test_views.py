"""Sessions, down-sampled plots, scores by level and exchange calendars against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import backtest, calendar, downsample, sessions

D = dt.datetime
TICKS = "k string, ts timestamp_ntz, v double, o bigint"


def tick_rows():
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 4 + ["b"]), D(2024, 3, 9, 22) + dt.timedelta(minutes=rng.randrange(3000)), rng.choice([rng.random()] * 8 + [None]), i) for i in range(200)]
    rows += [("hot", D(2024, 3, 10, 2, 30), 5.0, 900), ("hot", D(2024, 3, 10, 2, 30), 6.0, 901), (None, D(2024, 3, 10), 1.0, 902), ("b", None, 1.0, 903)]
    return rows + [("edge", D(2024, 5, 1, 0, 0), 1.0, 1), ("edge", D(2024, 5, 1, 0, 29, 59), 2.0, 2), ("edge", D(2024, 5, 1, 0, 59, 59), 3.0, 3)]


def brute_sessions(rows, gap):
    out = []
    for t in {r[0] for r in rows if r[0]}:
        mine, held = sorted((r[1], r[3], r[2]) for r in rows if r[0] == t and r[1] and r[2] is not None), []
        for r in [*mine, None]:
            if held and (r is None or r[0] - held[-1][0] > gap):
                v = [x[2] for x in held]
                out.append((t, held[0][0], held[-1][0], v[0], max(v), min(v), v[-1], len(v), pytest.approx(sum(v))))
                held = []
            if r:
                held.append(r)
    return sorted(out, key=lambda r: r[:2])


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_sessions_in_batch_and_stream(spark, zone, tmp_path):
    rows, want = tick_rows(), brute_sessions(tick_rows(), dt.timedelta(minutes=30))
    df = spark.createDataFrame(rows, TICKS).repartition(4)
    args = ("k", "ts", "v", "o", "30 minutes")
    plain = lambda x: sorted((tuple(r) for r in x.collect()), key=lambda r: r[:2])
    assert plain(sessions.session_bars(df, *args)) == want and len(want) > 20
    assert sessions.session_bars(df.limit(0), *args).collect() == []
    df.unionByName(spark.createDataFrame([("z", D(2025, 1, 1), 0.0, 9)], TICKS)).write.parquet(str(tmp_path / "src"))
    stream = sessions.session_bars(spark.readStream.schema(TICKS).parquet(str(tmp_path / "src")), *args, late="1 hour")
    q = stream.writeStream.outputMode("append").format("memory").queryName(f"s{zone[:3]}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert plain(spark.table(f"s{zone[:3]}")) == want  # the last tick only closes the others


@pytest.mark.parametrize("width", [1, 7, 50])
def test_m4(spark, width):
    rng = random.Random(4)
    rows = [(t, D(2024, 1, 1) + dt.timedelta(hours=rng.randrange(900)), rng.choice([float(rng.randrange(9))] * 7 + [None, math.nan, math.inf])) for t in ["hot"] * 400 + ["b"] * 30 + ["one"]]
    rows += [(None, D(2024, 1, 1), 1.0), ("b", None, 1.0), ("none", D(2024, 1, 1), None), ("same", D(2024, 1, 1), 1.0), ("same", D(2024, 1, 1), 2.0)]
    got = downsample.m4(spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, value double").repartition(3), width)
    want = set()
    for t in {r[0] for r in rows if r[0]}:
        mine = [(ts, v) for k, ts, v in rows if k == t and ts and v is not None and math.isfinite(v)]
        if not mine:
            continue
        a, b = min(mine)[0], max(mine)[0]
        pixels = {}
        for ts, v in mine:
            pixels.setdefault(0 if a == b else min(width - 1, int((ts - a) / (b - a) * width)), []).append((ts, v))
        for p, held in pixels.items():
            want |= {(t, p, *x) for x in (min(held, key=lambda x: (x[0], -x[1])), max(held), min(held, key=lambda x: (x[1], x[0])), min(held, key=lambda x: (-x[1], x[0])))}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert max(rows.count((t, p)) for t, p in {r[:2] for r in rows}) <= 4
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "windowspec" not in plan
    with pytest.raises(ValueError, match="pixel"):
        downsample.m4(got, 0)


def test_scores_by_level(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 5 + ["b", None]), rng.choice(["close", "volume"]), rng.randrange(1, 4), rng.choice([rng.gauss(0, 1)] * 9 + [None])) for _ in range(500)]
    levels, sets = ["ticker", "target", "step"], [("ticker", "target", "step"), ("ticker", "target"), ("target", "step"), ("target",), ()]
    made = backtest.level_scores(spark.createDataFrame(rows, "ticker string, target string, step int, error double").repartition(3), levels, sets)
    want = {}
    for s in sets:
        for *key, e in rows:
            if e is not None:
                at = tuple(k if c in s else None for c, k in zip(levels, key, strict=True)) + (sum(1 << (2 - i) for i, c in enumerate(levels) if c not in s),)
                want.setdefault(at, []).append(e)
    want = {k: (pytest.approx(sum(map(abs, v)) / len(v)), pytest.approx(sum(v) / len(v)), pytest.approx(math.sqrt(sum(x * x for x in v) / len(v))), len(v)) for k, v in want.items()}
    assert {tuple(r)[:4]: tuple(r)[4:] for r in made.collect()} == want
    assert str(made._jdf.queryExecution().executedPlan().toString()).count("Expand") == 0
    with pytest.raises(ValueError, match="unknown levels"):
        backtest.level_scores(spark.createDataFrame(rows, "ticker string, target string, step int, error double"), levels, [("interval",)])


def test_exchange_calendar(spark):
    closed, half = [dt.date(2024, 1, 1), dt.date(2024, 1, 15), dt.date(2024, 1, 15)], [dt.date(2024, 1, 12), dt.date(2024, 1, 13)]
    table = calendar.calendar_table(spark, dt.date(2024, 1, 1), dt.date(2090, 12, 31), closed, half)
    rows = spark.createDataFrame([("A", D(2024, 1, 11, 15, 30)), ("B", D(2024, 1, 13)), ("C", D(2024, 1, 1)), ("C", D(2024, 1, 1)), (None, D(2024, 1, 12)), ("N", None)], "ticker string, ts timestamp_ntz")
    got = sorted((tuple(r) for r in calendar.next_open_days(rows, table, "ts", 3).collect()), key=repr)
    day = lambda t, s, d, h=False: (t, s, D(2024, 1, d), h)
    want = [day("A", 1, 12, True), day("A", 2, 16), day("A", 3, 17), day("B", 1, 16), day("B", 2, 17), day("B", 3, 18), day(None, 1, 16), day(None, 2, 17), day(None, 3, 18)] + [day("C", s, s + 1) for s in (1, 1, 2, 2, 3, 3)]
    assert got == sorted(want, key=repr)
    far = calendar.next_open_days(rows.where("ticker = 'A'"), table, "ts", 10_000)
    opens = [d for d in (D(2024, 1, 12) + dt.timedelta(days=i) for i in range(15_000)) if d.weekday() < 5 and d.date() not in closed]
    assert [r.forecast_ts for r in far.orderBy("step").collect()] == opens[:10_000]
    with pytest.raises(Exception, match="no step"):
        calendar.next_open_days(rows.where("ticker = 'A'"), table, "ts", 20_000).collect()
    with pytest.raises(Exception, match="no step"):
        calendar.next_open_days(rows, table.where("day > '2024-02-01'"), "ts", 1).collect()
    with pytest.raises(ValueError):
        calendar.calendar_table(spark, dt.date(2024, 1, 2), dt.date(2024, 1, 1), [])
    every = calendar.calendar_table(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 7), [], weekend=())
    assert every.where("is_open").count() == 7
