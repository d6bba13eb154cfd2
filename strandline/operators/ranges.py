"""What is usually one window over a whole series, by ranges of time: positions, and values carried from row to row.

A range (day, month or year) of a series is ordered on its own; one row for each range holds what
goes over its border. So a ticker with a third of all rows is as many tasks as it has
ranges, and only its ranges' single rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import one_of
from strandline.storage import kept

SPANS = ("day", "month", "year")
#: For bars of each size, ranges of some hundred to some thousand.
SPAN_OF = {"1m": "day", "5m": "day", "15m": "month", "30m": "month", "1h": "month", "1d": "year", "1wk": "year", "1mo": "year"}


def span_start(ts: Column, span: str) -> Column:
    """The first day of the range that holds ts."""
    day = F.to_date(ts)
    return day if one_of("span", span, SPANS) == "day" else F.trunc(day, span)


def _met(rows: DataFrame, borders: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their range's border."""
    named = borders.select(*[F.col(c).alias(f"_at_{c}") for c in (*by, "_span")], *[c for c in borders.columns if c not in (*by, "_span")])
    return rows.join(named, [F.col(c) == F.col(f"_at_{c}") for c in (*by, "_span")], "left").drop(*[f"_at_{c}" for c in (*by, "_span")])


def positions(rows: DataFrame, by: list[str], at: str, span: str, name: str = "position") -> DataFrame:
    """rows and their number from 0 in order of `at` within `by`; rows with a null in these columns are left out."""
    whole = rows.dropna("any", subset=[*by, at]).withColumn("_span", span_start(F.col(at), span))
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    borders = whole.groupBy(*by, "_span").agg(F.count(F.lit(1)).alias("_n")).select(*by, "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = whole.withColumn("_inside", F.row_number().over(Window.partitionBy(*by, "_span").orderBy(at)))
    return _met(inside, borders, by).withColumn(name, F.col("_before") + F.col("_inside") - 1).select(*rows.columns, name)


def carried(rows: DataFrame, by: list[str], at: list[str], span: str, values: dict[str, tuple[str, str]]) -> DataFrame:
    """rows and, by name, the nearest known value of a column at or before ("last") or at or after ("next") each row.

    values: name -> (column, "last" or "next"). Rows are in order of `at`, whose first column gives
    the range; a null isn't known. Columns of `by` and `at` must not be null. rows are read twice: keep
    them first where they are costly.
    """
    whole, start = rows.withColumn("_span", span_start(F.col(at[0]), span)), Window.unboundedPreceding
    place, sums, over = F.struct(*at), [], []
    for name, (column, way) in values.items():
        known = F.when(F.col(column).isNotNull(), place)
        nearest, order = (F.max_by, F.asc) if one_of("way", way, ("last", "next")) == "last" else (F.min_by, F.desc)
        sums.append(nearest(column, known).alias(f"_end_{name}"))
        over.append(F.last(f"_end_{name}", True).over(Window.partitionBy(*by).orderBy(order("_span")).rowsBetween(start, -1)).alias(f"_border_{name}"))
    borders = whole.groupBy(*by, "_span").agg(*sums).select(*by, "_span", *over)
    for name, (column, way) in values.items():
        order = [F.asc(c) if way == "last" else F.desc(c) for c in at]
        whole = whole.withColumn(f"_in_{name}", F.last(column, True).over(Window.partitionBy(*by, "_span").orderBy(*order).rowsBetween(start, 0)))
    found = _met(whole, borders, by)
    return found.select(*rows.columns, *[F.coalesce(f"_in_{n}", f"_border_{n}").alias(n) for n in values])


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], tolerance: str | None = None, span: str = "month") -> DataFrame:
    """All rows of left, each with `values` of right's latest row at or before it, and that row's time as matched_ts.

    Rows match within equal `by` and, where given, a tolerance such as "3 days". Rows of right with
    equal keys and times: the greatest values in their order count. Rows of left with a null key
    or time, or without a match, have nulls. Rows of right with a null key or time match nothing.
    """
    found = F.struct(F.col(right_at).alias("matched_ts"), *[F.col(v) for v in values])
    from_right = right.dropna("any", subset=[*by, right_at]).groupBy(*by, F.col(right_at)).agg(F.max(F.struct(*values)).alias("_v")).select(*by, right_at, "_v.*")
    from_right = from_right.select(*by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), found.alias("_found"))
    kind = from_right.schema["_found"].dataType
    ready = kept(left.select(F.struct(*left.columns).alias("_row")), "as-of")
    keys = [F.col(f"_row.{c}").alias(c) for c in by]
    asks = ready.select(*keys, F.col(f"_row.{left_at}").alias("_at"), F.lit(1).alias("_side"), "_row", F.lit(None).cast(kind).alias("_found"))
    whole = F.lit(True)
    for c in (*by, "_at"):
        whole = whole & F.col(c).isNotNull()
    both = asks.where(whole).unionByName(from_right, allowMissingColumns=True)
    met = carried(both, by, ["_at", "_side"], span, {"_match": ("_found", "last")}).where("_side = 1")
    near = F.lit(True) if tolerance is None else F.col("_match.matched_ts") >= F.col("_at") - F.expr(f"INTERVAL {tolerance}")
    met = met.select("_row", F.when(near, F.col("_match")).alias("_match")).unionByName(asks.where(~whole).select("_row", F.col("_found").alias("_match")))
    return met.select("_row.*", "_match.*")
