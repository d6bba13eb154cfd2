"""Exchange calendars: a table of days with running numbers of open ones, so that the n-th next open day is a lookup."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def calendar_table(spark: SparkSession, first: date, last: date, closed: list[date], half: list[date] = (), weekend: tuple[int, ...] = (5, 6)) -> DataFrame:
    """(day, is_open, half_day, number): every day from first to last; number counts the open days up to and including it.

    weekend: the closed weekdays, Monday is 0. A calendar has some hundred rows a year, which is what the window over
    all of them orders.
    """
    if last < first:
        raise ValueError(f"a calendar can't end on {last} before it begins on {first}")
    span = (last - first).days + 1
    shut, short = (F.array(*[F.lit(d) for d in sorted(set(x))]).cast("array<date>") for x in (closed, half))
    days = spark.range(span).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    is_open = ~F.weekday("day").isin(*weekend) & ~F.array_contains(shut, F.col("day")) if weekend else ~F.array_contains(shut, F.col("day"))
    flagged = days.select("day", is_open.alias("is_open"), (is_open & F.array_contains(short, F.col("day"))).alias("half_day"))
    return flagged.withColumn("number", F.sum(F.col("is_open").cast("int")).over(Window.orderBy("day")))


def next_open_days(rows: DataFrame, table: DataFrame, ts: str, horizon: int, keep: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(keep, step, forecast_ts, half_day): the horizon open days after the day of ts, at midnight, for each row.

    A row looks up its day's number and then the numbers after it, so nothing is scanned and no array of days
    is made. Days before the calendar begins, and steps beyond its end, are an error when they are read;
    rows without ts give none.
    """
    if horizon < 1:
        raise ValueError(f"horizon must be at least 1, not {horizon}")
    here = table.select(F.col("day").alias("_day"), F.col("number").alias("_from"))
    opens = table.where("is_open").select(F.col("number").alias("_number"), F.col("day").alias("_open"), "half_day")
    started = rows.where(F.col(ts).isNotNull()).select(*keep, F.to_date(ts).alias("_day")).join(here, "_day", "left")
    wanted = started.select(*keep, "_from", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).withColumn("_number", F.col("_from") + F.col("step"))
    found = wanted.join(opens, "_number", "left")
    beyond = F.raise_error(F.concat(F.lit("the calendar has no step "), F.col("step").cast("string"))).cast("timestamp_ntz")
    return found.select(*keep, "step", F.coalesce(F.col("_open").cast("timestamp_ntz"), beyond).alias("forecast_ts"), "half_day")
