"""Runs in SQLite files: made of real forecasts, read back equal; pushed filters; hostile bytes."""

import os
import pickle
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.operators import history
from strandline.plans.queries import _records
from strandline.sources.sqlite_runs import TABLE, floats_of, read_sqlite_runs

SF = "/root/testdata/sf0.001"
TYPES = "id INTEGER PRIMARY KEY, timestamp DATETIME, ticker TEXT, interval TEXT, context_length INTEGER, horizon_length INTEGER, model_repo TEXT, period INTEGER, forecast_data BLOB, mae_score REAL"


def file_of(path, rows):
    con = sqlite3.connect(path)
    con.execute(f"CREATE TABLE {TABLE} ({TYPES})")
    con.executemany(f"INSERT INTO {TABLE} VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", rows)
    con.commit()
    con.close()
    return str(path)


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_runs_of_forecasts_come_back_equal(spark, tmp_path, partitions):
    runs = _records(spark, SF).collect()
    rows = [(r.id, "2024-01-01 00:00:00", r.ticker, r.interval, r.context_length, r.horizon_length, r.model_repo, r.period, pickle.dumps(r.forecast_data, k), r.mae_score) for k, r in enumerate(runs)]
    got = read_sqlite_runs(spark, file_of(tmp_path / "h.db", rows), partitions)
    assert got.schema == history.RUNS
    same = lambda r: (r.id, str(r.timestamp), r.ticker, r.interval, r.context_length, r.horizon_length, r.model_repo, r.period, r.forecast_data, r.mae_score)
    assert sorted(map(same, got.collect())) == sorted(map(same, runs)) and len(runs) == 5
    history.save_runs(spark, str(tmp_path / "store"), got.drop("id"))
    assert history.read_runs(spark, str(tmp_path / "store")).count() == 5


def test_filters_nulls_and_empty_tables(spark, tmp_path):
    rows = [(i, None if i == 7 else f"2024-01-{i % 28 + 1:02} 10:00:00", None if i == 3 else f"t{i % 4}", "1d", i, 7, "m", "2y" if i % 2 else 5, pickle.dumps([float(i)]), None if i % 3 else i / 10) for i in range(1, 201)]
    got = read_sqlite_runs(spark, file_of(tmp_path / "h.db", rows), 4)
    plain = {r.id: r for r in got.collect()}
    assert len(plain) == 200 and plain[7].timestamp is None and plain[3].ticker is None and {plain[1].period, plain[2].period} == {"2y", "5"}
    for where in ("id = 5", "id > 190 AND ticker = 't1'", "ticker IN ('t0', 't2')", "mae_score IS NULL", "NOT ticker = 't1'", "mae_score >= 5.4 OR id < 3", "ticker <=> 't2'", "period = '2y'", "timestamp > '2024-01-20'", "id = -1", "ticker LIKE 't%'", "ticker = 'T1'"):
        assert {r.id for r in got.where(where).collect()} == {r.id for r in spark.createDataFrame(list(plain.values()), history.RUNS).where(where).collect()}, where
    path = str(tmp_path / "h.db")
    assert {r.id for r in read_sqlite_runs(spark, path, 4, min_id=10, max_id=60, tickers=["t1", "it's"]).collect()} == {i for i in range(10, 61) if i % 4 == 1}
    assert read_sqlite_runs(spark, path, tickers=[]).collect() == [] and read_sqlite_runs(spark, path, min_id=500).collect() == []
    assert got.where("id BETWEEN 10 AND 12").agg(F.sum(F.col("forecast_data")[0])).first()[0] == 33.0
    assert read_sqlite_runs(spark, file_of(tmp_path / "empty.db", [])).collect() == []
    with pytest.raises(Exception, match="unable to open"):
        read_sqlite_runs(spark, str(tmp_path / "none.db")).collect()


class Hostile:
    def __reduce__(self):
        return os.system, ("touch /tmp/should-not-exist",)


def test_hostile_and_broken_bytes_are_errors(spark, tmp_path):
    good = pickle.dumps([1.0, 2.0])
    for blob in (pickle.dumps(Hostile()), pickle.dumps([Hostile()]), pickle.dumps({"a": 1}), pickle.dumps([[1.0]]), pickle.dumps(["x"]), pickle.dumps((1.0,)), pickle.dumps([True]), pickle.dumps([None]), good[:-1], good[:-4], b"", b"junk", good[1:], b"(lF1\nF2\na."):
        with pytest.raises(ValueError, match="stored forecast"):
            floats_of(blob)
    path = file_of(tmp_path / "h.db", [(1, None, "t", "1d", 1, 1, "m", "max", pickle.dumps(Hostile()), None)])
    with pytest.raises(Exception, match="not a list of numbers"):
        read_sqlite_runs(spark, path).collect()
    assert not os.path.exists("/tmp/should-not-exist")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.floats(allow_nan=False), st.integers(-(2**70), 2**70)), max_size=2500), st.integers(0, 5))
def test_lists_of_numbers(values, protocol):
    assert floats_of(pickle.dumps(values, protocol)) == [float(v) for v in values]
    assert floats_of(None) is None
