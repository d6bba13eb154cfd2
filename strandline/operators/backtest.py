"""Rolling-origin backtests: forecasts from many cut-offs in one pass over the bars.

Every bar is dealt to the cut-offs that see it: those after it, as long as it is among the last n bars
before them. Which these are follows from its number in the series and from how many bars
each cut-off has before it. The means for missing values are running sums over the cut-offs. So
hundreds of cut-offs read the bars once, and a context gathers n bars at most; no task orders
or holds a whole series.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline import forecasters
from strandline.config import ForecastConfig, one_of
from strandline.functions.series import edge_pad, known
from strandline.operators.ranges import SPAN_OF, positions
from strandline.plans.pipeline import stepped


def rolling_contexts(series: DataFrame, cutoffs: list[date | datetime], context_length: int, interval: str = "1d", impute: str = "mean") -> DataFrame:
    """The contexts of `contexts` for each ticker and cut-off (origin), of the rows before it; tickers without any have none.

    Rows without ticker or ts are left out. With impute "mean", missing values are the mean of the ticker's
    known ones before the origin, and contexts without any are left out; with "none" they stay.
    """
    one_of("impute", impute, ("mean", "none"))
    stamps = sorted({str(datetime(c.year, c.month, c.day) if not isinstance(c, datetime) else c) for c in cutoffs})
    if not stamps:
        raise ValueError("a backtest needs at least one cut-off")
    cuts = F.array(*[F.lit(s).cast("timestamp_ntz") for s in stamps])
    rows = series.dropna("any", subset=["ticker", "ts"]).select("ticker", "ts", "value", F.size(F.filter(cuts, lambda c: c <= F.col("ts"))).alias("_first"))
    rows = rows.where(F.col("_first") < len(stamps))
    value = known(F.col("value"))
    parts = rows.groupBy("ticker", "_first").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum"), F.count(value).alias("_count"))
    every = parts.select("ticker").distinct().select("ticker", F.explode(F.sequence(F.lit(0), F.lit(len(stamps) - 1))).alias("_first"))
    sofar = Window.partitionBy("ticker").orderBy("_first").rowsBetween(Window.unboundedPreceding, 0)
    running = every.join(parts, ["ticker", "_first"], "left").select("ticker", F.col("_first").alias("_cut"), *[F.coalesce(F.sum(c).over(sofar), F.lit(0)).alias(c) for c in ("_n", "_sum", "_count")])
    seen = running.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("_cut", "_n")))["_n"].alias("_seen"))
    placed = positions(rows, ["ticker"], "ts", SPAN_OF[interval], "_at").join(seen, "ticker")
    last = F.size(F.filter("_seen", lambda n: n <= F.col("_at") + context_length)) - 1
    dealt = placed.select("ticker", "ts", "value", "_first", last.alias("_last")).where("_last >= _first")
    dealt = dealt.select("ticker", "ts", "value", F.explode(F.sequence("_first", "_last")).alias("_cut"))
    if impute == "mean":
        means = running.select("ticker", "_cut", F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count")).alias("_mean"))
        dealt = dealt.join(means, ["ticker", "_cut"]).where("_mean IS NOT NULL").select("ticker", "ts", "_cut", F.coalesce(value, F.col("_mean")).alias("value"))
    made = dealt.groupBy("ticker", "_cut").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("_rows"))
    n = F.size("_rows")
    return made.select(
        "ticker", F.element_at(cuts, F.col("_cut") + 1).alias("origin"), F.element_at("_rows.ts", -1).alias("last_ts"), n.alias("n_raw"),
        (F.lit(context_length) - n).alias("n_padded"), F.lit(context_length).alias("context_length"), edge_pad(F.col("_rows.value"), context_length).alias("context"),
    )


def rolling_forecasts(series: DataFrame, cutoffs: list[date | datetime], cfg: ForecastConfig) -> DataFrame:
    """(ticker, origin, step, forecast_ts, forecast_value) of series (ticker, ts, value); cfg's range and target are not read."""
    made = rolling_contexts(series, cutoffs, cfg.effective_context_length, cfg.interval, cfg.impute)
    return stepped(forecasters.apply(made, cfg), cfg, ("ticker", "origin"))


def rolling_errors(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """forecasts and their error (forecast less actual value) where actuals (ticker, ts, value) has a known one at that time."""
    real = actuals.select("ticker", F.col("ts").alias("forecast_ts"), known(F.col("value")).alias("_actual")).where("_actual IS NOT NULL")
    return forecasts.join(real, ["ticker", "forecast_ts"]).withColumn("error", F.col("forecast_value") - F.col("_actual")).drop("_actual")


def error_scores(errors: DataFrame, *by: str) -> DataFrame:
    """Mean absolute and mean error, root of the mean square, and their number, for each value of `by`."""
    e = F.col("error")
    return errors.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae_score"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n_matched"))


def level_scores(errors: DataFrame, levels: list[str], sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """`error_scores` at several levels at once: (levels, grouping_id, mae_score, bias, rmse, n_matched).

    sets: the combinations of levels, by default for (ticker, target, step) all three, ticker and target, target and
    step, and target. A level that a row sums over is null and has its bit in grouping_id, first level highest.
    Errors are summed by all levels first, with map-side combining, and only these sums are expanded and
    shuffled again, so subtotals cost no second pass over the errors.
    """
    sets = sets or [tuple(levels), tuple(levels[:2]), tuple(levels[1:]), (levels[1],)]
    if unknown := {c for s in sets for c in s} - set(levels):
        raise ValueError(f"unknown levels {sorted(unknown)}; there are {', '.join(levels)}")
    e = F.col("error")
    fine = errors.where(e.isNotNull()).groupBy(*levels).agg(F.sum(F.abs(e)).alias("_abs"), F.sum(e).alias("_sum"), F.sum(e * e).alias("_square"), F.count(F.lit(1)).alias("_n"))
    bits = {c: 1 << (len(levels) - 1 - i) for i, c in enumerate(levels)}
    each = [F.struct(*[(F.col(c) if c in s else F.lit(None).cast(fine.schema[c].dataType)).alias(c) for c in levels], F.lit(sum(b for c, b in bits.items() if c not in s)).cast("bigint").alias("grouping_id")) for s in sets]
    rows = fine.select(F.explode(F.array(*each)).alias("_level"), "_abs", "_sum", "_square", "_n").select("_level.*", "_abs", "_sum", "_square", "_n")
    n = F.sum("_n")
    return rows.groupBy(*levels, "grouping_id").agg((F.sum("_abs") / n).alias("mae_score"), (F.sum("_sum") / n).alias("bias"), F.sqrt(F.sum("_square") / n).alias("rmse"), n.alias("n_matched"))
