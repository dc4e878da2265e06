"""Calendar keys and business-day arithmetic as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HORIZONS = ("daily", "weekly", "monthly")


def known_horizon(horizon: str) -> str:
    """The horizon itself, if it is one of the three."""
    if horizon not in HORIZONS:
        raise ValueError(f"no such horizon: {horizon!r}; there are {', '.join(HORIZONS)}")
    return horizon


def week_id(date: Column) -> Column:
    """ISO year * 100 + ISO week (2021-01-03 -> 202053)."""
    return (F.extract(F.lit("YEAROFWEEK"), date) * 100 + F.weekofyear(date)).cast("int")


def month_id(date: Column) -> Column:
    """year * 100 + month."""
    return (F.year(date) * 100 + F.month(date)).cast("int")


def weekday0(date: Column) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6 (pandas ``dayofweek``)."""
    return F.weekday(date)


def period_id(date: Column, horizon: str) -> Column:
    """Candle key of a horizon; daily candles are keyed by the date itself."""
    by_day = F.date_format(date, "yyyyMMdd").cast("int")
    return {"daily": by_day, "weekly": week_id(date), "monthly": month_id(date)}[known_horizon(horizon)]


def weekdays_to_month_end(date: Column) -> Column:
    """Number of Monday-Friday days in (date, last_day(date)].

    n = days to month end = 7q + m; the q full weeks hold 5q weekdays and the
    remaining m days (date+1 .. date+m) are counted one by one (m <= 6).
    """
    n = F.datediff(F.last_day(date), date)
    q = F.floor(n / 7).cast("int")
    m = n - q * 7
    w = weekday0(date)
    tail = sum(
        F.when((F.lit(j) <= m) & (F.pmod(w + j, F.lit(7)) < 5), F.lit(1)).otherwise(F.lit(0))
        for j in range(1, 7)
    )
    return q * 5 + tail


def candle_part(date: Column, horizon: str) -> Column:
    """Where in its candle a date lies: the weekday (Monday = 0), of monthly candles the week of the month (0 to 4)."""
    if known_horizon(horizon) == "monthly":
        return F.floor((F.dayofmonth(date) - 1) / 7).cast("int")
    return weekday0(date)
