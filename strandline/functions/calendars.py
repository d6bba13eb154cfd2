"""Future timestamps as arrays, from the last bar's time; all stay TIMESTAMP_NTZ."""

from __future__ import annotations

from calendar import monthrange
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.config import INTERVALS, one_of

_MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30}


def business_days(ts: str, horizon: int) -> Column:
    """Mondays to Fridays after the day of ts, at midnight, holidays not known."""
    span = horizon // 5 * 7 + 14
    days = f"filter(sequence(date_add(to_date({ts}), 1), date_add(to_date({ts}), {span})), d -> weekday(d) < 5)"
    return F.expr(f"transform(slice({days}, 1, {horizon}), d -> cast(d as timestamp_ntz))")


def steps(ts: str, interval: str, horizon: int) -> Column:
    """ts plus 1 to horizon times the interval; months are added to ts itself and clamp to month ends."""
    if interval in _MINUTES:
        unit = f"make_dt_interval(0, 0, {_MINUTES[interval]} * i)"
    else:
        unit = {"1h": "make_dt_interval(0, i)", "1d": "make_dt_interval(i)", "1wk": "make_dt_interval(7 * i)", "1mo": "make_ym_interval(0, i)"}[interval]
    return F.expr(f"transform(sequence(1, {horizon}), i -> {ts} + {unit})")


def anchored(ts: str, interval: str, horizon: int) -> Column:
    """Sundays (1wk) or month ends (1mo) from one hour after ts on, keeping that time of day."""
    u = f"({ts} + make_dt_interval(0, 1))"
    time_of_day = f"({u} - cast(to_date({u}) as timestamp_ntz))"
    day = {
        "1wk": f"date_add(next_day(date_sub(to_date({u}), 1), 'SU'), 7 * i)",
        "1mo": f"last_day(add_months(trunc(to_date({u}), 'MM'), i))",
    }[interval]
    return F.expr(f"transform(sequence(0, {horizon} - 1), i -> cast({day} as timestamp_ntz) + {time_of_day})")


def future(ts: str, interval: str, horizon: int, policy: str = "step") -> Column:
    """The horizon timestamps after the column named ts."""
    one_of("interval", interval, INTERVALS)
    if interval == "1d":
        return business_days(ts, horizon)
    if policy == "anchored" and interval in ("1wk", "1mo"):
        return anchored(ts, interval, horizon)
    return steps(ts, interval, horizon)


def listed(ts: datetime, interval: str, horizon: int, policy: str = "step") -> list[datetime]:
    """The timestamps of `future` for one value, in Python."""
    one_of("interval", interval, INTERVALS)
    midnight = datetime(ts.year, ts.month, ts.day)
    if interval == "1d":
        days = (midnight + timedelta(days=i) for i in range(1, horizon // 5 * 7 + 15))
        return [d for d in days if d.weekday() < 5][:horizon]
    if policy == "anchored" and interval in ("1wk", "1mo"):
        hour = ts + timedelta(hours=1)
        day = datetime(hour.year, hour.month, hour.day)
        if interval == "1wk":
            sunday = day + timedelta(days=6 - day.weekday())
            ends = [sunday + timedelta(days=7 * i) for i in range(horizon)]
        else:
            ends = [_shifted(day.replace(day=1), i + 1) - timedelta(days=1) for i in range(horizon)]
        return [e + (hour - day) for e in ends]
    if interval == "1mo":
        return [_shifted(ts, i) for i in range(1, horizon + 1)]
    step = timedelta(minutes=_MINUTES.get(interval, 0)) or {"1h": timedelta(hours=1), "1wk": timedelta(days=7)}[interval]
    return [ts + step * i for i in range(1, horizon + 1)]


def _shifted(ts: datetime, months: int) -> datetime:
    """The same day so many months on, or the month's last."""
    year, month = divmod(ts.year * 12 + ts.month - 1 + months, 12)
    return ts.replace(year=year, month=month + 1, day=min(ts.day, monthrange(year, month + 1)[1]))
