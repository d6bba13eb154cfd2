"""Plots of long series: the rows that a line of so many pixels shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.series import known


def m4(series: DataFrame, width: int) -> DataFrame:
    """(ticker, pixel, ts, value): of each pixel column the first, last, least and largest value, at most four rows.

    A line through these rows covers the same pixels as one through all of them. The columns divide the time
    from a ticker's first to its last known value evenly; the last value is in the last. Missing values
    and rows without ticker or ts are left out. Ties: the earliest of equal values, the greatest value of
    equal times. One aggregation with map-side combining makes all four, after one for the ends.
    """
    if width < 1:
        raise ValueError(f"a plot must be at least 1 pixel wide, not {width}")
    rows = series.select("ticker", "ts", known(F.col("value")).alias("value")).where("ticker IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL")
    ends = rows.groupBy("ticker").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    micros = lambda a, b: F.expr(f"timestampdiff(MICROSECOND, {a}, {b})").cast("double")
    pixel = F.when(F.col("_a") == F.col("_b"), 0).otherwise(F.least(F.lit(width - 1), F.floor(micros("_a", "ts") / micros("_a", "_b") * width).cast("int")))
    placed = rows.join(ends, "ticker").select("ticker", pixel.alias("pixel"), "ts", "value")
    point = F.struct("ts", "value")
    four = placed.groupBy("ticker", "pixel").agg(
        F.min_by(point, F.struct("ts", -F.col("value"))).alias("first"), F.max_by(point, F.struct("ts", "value")).alias("last"),
        F.min_by(point, F.struct("value", "ts")).alias("least"), F.min_by(point, F.struct(-F.col("value"), F.col("ts"))).alias("largest"),
    )
    return four.select("ticker", "pixel", F.explode(F.array_distinct(F.array("first", "last", "least", "largest"))).alias("_p")).select("ticker", "pixel", "_p.*")
