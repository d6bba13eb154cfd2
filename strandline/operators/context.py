"""From bars to one fixed-length context per ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import TARGETS, one_of, round_context
from strandline.functions.series import edge_pad, known


def target_of(bars: DataFrame, target: str) -> DataFrame:
    """(ticker, ts, value): the target column as double."""
    one_of("target", target, TARGETS)
    if target not in bars.columns:
        raise ValueError(f"the bars have no column {target}")
    return bars.select("ticker", "ts", F.col(target).cast("double").alias("value"))


def missing_summary(series: DataFrame) -> DataFrame:
    """Per ticker: rows, missing rows, and whether all are missing."""
    return series.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) - F.count(known(F.col("value")))).alias("n_missing"),
        (F.count(known(F.col("value"))) == 0).alias("all_missing"),
    )


def means_of(series: DataFrame) -> DataFrame:
    """(ticker, _mean) of the known values of whole series: one row per ticker."""
    return series.groupBy("ticker").agg(F.avg(known(F.col("value"))).alias("_mean"))


def filled(rows: DataFrame, means: DataFrame, strict: bool = False) -> DataFrame:
    """Missing values of rows become their ticker's mean; tickers without one are left out, or with strict make the job fail."""
    joined = rows.join(means, "ticker")
    if strict:
        joined = joined.withColumn("_mean", F.when(F.col("_mean").isNull(), F.raise_error(F.concat(F.lit("no values: "), F.col("ticker")))).otherwise(F.col("_mean")))
    return joined.where(F.col("_mean").isNotNull()).select("ticker", "ts", F.coalesce(known(F.col("value")), F.col("_mean")).alias("value"))


def impute_mean(series: DataFrame, strict: bool = False) -> DataFrame:
    """Missing values become the mean of the ticker's whole series."""
    return filled(series, means_of(series), strict)


def last_n(series: DataFrame, n: int) -> DataFrame:
    """The n latest rows of each ticker; the rank limits rows before the shuffle."""
    w = Window.partitionBy("ticker").orderBy(F.col("ts").desc())
    return series.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def contexts(series: DataFrame, context_length: int, impute: str = "mean", strict: bool = False) -> DataFrame:
    """One row per ticker: last_ts, n_raw, n_padded, context_length, context.

    At most context_length rows of a ticker are gathered, whatever its length, and only these
    meet the means.
    """
    n = round_context(context_length)
    latest = last_n(series, n)
    rows = (filled(latest, means_of(series), strict) if impute == "mean" else latest).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("_rows"))
    values = F.col("_rows.value")
    return rows.select(
        "ticker",
        F.element_at("_rows.ts", -1).alias("last_ts"),
        F.size("_rows").alias("n_raw"),
        (F.lit(n) - F.size("_rows")).alias("n_padded"),
        F.lit(n).alias("context_length"),
        edge_pad(values, n).alias("context"),
    )
