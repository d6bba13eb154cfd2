"""Run history as a Parquet table: append, list, overlay, score, delete. One writer at a time.

Ids are never given twice: what rewrites a table keeps the highest id beside it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.series import known
from strandline.storage import kept

RUNS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("interval", T.StringType()),
    T.StructField("context_length", T.IntegerType()),
    T.StructField("horizon_length", T.IntegerType()),
    T.StructField("model_repo", T.StringType()),
    T.StructField("period", T.StringType()),
    T.StructField("forecast_data", T.ArrayType(T.DoubleType())),
    T.StructField("mae_score", T.DoubleType()),
    T.StructField("target", T.StringType()),
    T.StructField("effective_context_length", T.IntegerType()),
    T.StructField("last_ts", T.TimestampNTZType()),
    T.StructField("forecast_ts", T.ArrayType(T.TimestampNTZType())),
])
REQUIRED = ("ticker", "interval", "context_length", "horizon_length", "model_repo", "period", "forecast_data")


def init_store(spark: SparkSession, path: str) -> None:
    """Create the empty table where there is none."""
    try:
        spark.read.schema(RUNS).parquet(path).limit(0).collect()
    except AnalysisException:
        spark.createDataFrame([], RUNS).write.parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(path)


def run_records(forecasts: DataFrame, settings: dict, series: DataFrame | None = None) -> DataFrame:
    """One record per ticker of the forecasts, with the times of its steps; settings gives the other columns.

    Settings hold what was asked for (context_length) and what was used
    (effective_context_length); last_ts is the last time of each ticker in series, what was
    forecast from; mae_score stays null until a run is scored.
    """
    rows = forecasts.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("step", "forecast_value", "forecast_ts"))).alias("_rows"))
    values = {f.name: F.lit(settings.get(f.name)).cast(f.dataType) for f in RUNS if f.name in settings}
    made = rows.select("ticker", F.col("_rows.forecast_value").alias("forecast_data"), F.col("_rows.forecast_ts").alias("forecast_ts"), *[v.alias(k) for k, v in values.items()])
    return made if series is None else made.join(series.groupBy("ticker").agg(F.max("ts").alias("last_ts")), "ticker", "left")


def validated(records: DataFrame) -> DataFrame:
    """Fails the job at the first record that lacks a required column's value."""
    for name in REQUIRED:
        records = records.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} must not be null")).cast(RUNS[name].dataType)).otherwise(F.col(name)))
    return records


def numbered(records: DataFrame, after: int) -> DataFrame:
    """Ids from after + 1 on in order of ticker and target.

    Only one row per ticker and target, without its forecast, goes through the window that orders all.
    """
    keys = [c for c in ("ticker", "target") if c in records.columns]
    ordered = Window.orderBy(*keys)
    counts = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in keys], (F.sum("_n").over(ordered) - F.col("_n")).alias("_start"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    placed = records.join(starts, same).withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    have = {f.name: F.col(f.name) if f.name in records.columns else F.lit(None).cast(f.dataType) for f in RUNS}
    have["id"] = F.lit(after) + F.col("_start") + F.col("_at")
    if "timestamp" not in records.columns:
        have["timestamp"] = F.current_timestamp()
    return placed.select(*[have[f.name].cast(f.dataType).alias(f.name) for f in RUNS])


MARKS = "top bigint"


def top_id(spark: SparkSession, path: str) -> int:
    """The highest id ever given in the store, also to runs deleted since; marks stand beside it in <path>-ids."""
    tops = [read_runs(spark, path).agg(F.max("id")).first()[0]]
    try:
        tops.append(spark.read.schema(MARKS).parquet(f"{path}-ids").agg(F.max("top")).first()[0])
    except AnalysisException:
        pass  # nothing has been deleted
    return max((t for t in tops if t is not None), default=0)


def save_runs(spark: SparkSession, path: str, records: DataFrame) -> None:
    """Append the records with ids above any that was ever in the table.

    The records are made once, so a forecaster runs once for each series; the steps that count and
    number them read the stored ones.
    """
    made = kept(validated(records), "records")
    if made.isEmpty():
        raise ValueError("there is no forecast to save")
    init_store(spark, path)
    numbered(made, top_id(spark, path)).write.mode("append").parquet(path)


def history_grid(runs: DataFrame) -> DataFrame:
    """Newest first, without the forecast array."""
    return runs.drop("forecast_data").orderBy(F.col("timestamp").desc(), F.col("id").desc())


def steps_of(runs: DataFrame) -> DataFrame:
    """(id, ticker, step, ts, value) of all runs; ts is null for runs saved without times."""
    each = runs.select("id", "ticker", "forecast_ts", F.posexplode("forecast_data").alias("_pos", "value"))
    return each.select("id", "ticker", (F.col("_pos") + 1).alias("step"), F.get("forecast_ts", F.col("_pos")).alias("ts"), "value")


def overlay(runs: DataFrame, run_ids: list[int], series: DataFrame | None = None) -> DataFrame:
    """(id, ticker, step, ts, value) of chosen runs; with series also the actual values of their tickers, without id and step."""
    chosen = runs.where(F.col("id").isin(run_ids))
    steps = steps_of(chosen)
    if series is None:
        return steps
    none = {"id": F.lit(None).cast("bigint"), "step": F.lit(None).cast("int")}
    actual = series.join(chosen.select("ticker").distinct(), "ticker", "left_semi").withColumns(none)
    return steps.unionByName(actual.select("id", "ticker", "step", "ts", "value"))


def scored_runs(runs: DataFrame, series: DataFrame) -> DataFrame:
    """runs with mae_score: the mean absolute error over the steps that series has a value for; without any it stays as it is."""
    real = series.where(known(F.col("value")).isNotNull()).select("ticker", "ts", F.col("value").alias("_actual"))
    errors = steps_of(runs).join(real, ["ticker", "ts"]).groupBy(F.col("id").alias("_id")).agg(F.avg(F.abs(F.col("value") - F.col("_actual"))).alias("_mae"))
    joined = runs.join(errors, F.col("id") == F.col("_id"), "left").withColumn("mae_score", F.coalesce("_mae", "mae_score"))
    return joined.select(*runs.columns)


def without_runs(runs: DataFrame, doomed: DataFrame) -> DataFrame:
    return runs.join(doomed.select("id"), "id", "left_anti").select(*runs.columns)


def rewrite(spark: SparkSession, path: str, new_path: str, runs: DataFrame) -> None:
    """Writes what path is to become to new_path, with the highest id given so far; the caller switches over, as Parquet has no update."""
    runs.write.parquet(new_path)
    spark.createDataFrame([(top_id(spark, path),)], MARKS).write.parquet(f"{new_path}-ids")


def delete_runs(spark: SparkSession, path: str, new_path: str, doomed: DataFrame) -> None:
    rewrite(spark, path, new_path, without_runs(read_runs(spark, path), doomed))


def score_runs(spark: SparkSession, path: str, new_path: str, series: DataFrame) -> None:
    """Fills mae_score from series (ticker, ts, value)."""
    rewrite(spark, path, new_path, scored_runs(read_runs(spark, path), series))
