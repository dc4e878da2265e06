"""Raw indicator blocks X0-X8: daily, weekly and monthly technical indicators
on every daily row, with the still-open week/month folded in.

Plan shape (one lazy plan for all tickers at once):

    bars --(hash by ticker)--> daily windows (W(t), W(candle))
        \\-> groupBy(ticker, week)  -> period windows W(p) -/ join (ticker, week)
        \\-> groupBy(ticker, month) -> period windows W(p) -/ join (ticker, month)
    gauge -> as-of calendar (one row per date) -/ join Date

The period aggregates and the joins reuse the ticker hash partitioning of the
daily frame, so the only exchange of bar rows is the one on ticker.  Every
period column of a horizon travels in one period table and one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_id, week_id
from ..sources.bars import drop_missing_close
from .ranges import blocked
from .seq import ewm_mean, frame_sql, over_sql, rolling_sql, running_sql, shift_sql

# Fixed values of the indicator definitions.
BACKEND_PERIODS = (10, 50, 100, 150, 200)   # moving-average periods of the data layer
MODEL_PERIODS = (20, 50, 100, 150, 200)     # moving-average periods of the modelling layer
BB_PERIOD = 20                              # Bollinger period
BB_K = 2.0                                  # Bollinger width in population sigmas
RSI_ALPHA = 1.0 / 14.0                      # Wilder smoothing
RSI_MA_LENGTH = 14                          # RSI moving-average length
VOLUME_AVG_WINDOW = 90                      # daily volume average window
DEFAULT_START = "2000-01-01"                # default trim cutoff (strict >)

HORIZON_KEYS = {"weekly": ("week_id", "week"), "monthly": ("month_id", "month")}


def span_alpha(period: int) -> float:
    return 2.0 / (period + 1.0)


def gauge_asof(dates: DataFrame, gauge: DataFrame) -> DataFrame:
    """For every date in ``dates`` the last gauge Close at or before it.

    The gauge has its own calendar, so the bar dates and the gauge dates are
    merged into one calendar and the last known value is carried forward
    within each year (a window partitioned by year); a date before its year's
    first gauge value takes the last value of the earlier years, found on a
    table with one row per year.  The result has one row per bar date.
    """
    cal = dates.select("Date").distinct().select(
        "Date", F.lit(None).cast("double").alias("g"), F.lit(1).alias("src"))
    obs = gauge.where(F.col("Close").isNotNull()).select(
        "Date", F.col("Close").cast("double").alias("g"), F.lit(0).alias("src"))
    u = cal.unionByName(obs).withColumn("_y", F.year("Date"))
    in_year = Window.partitionBy("_y").orderBy("Date", "src").rowsBetween(Window.unboundedPreceding, 0)
    per_year = (obs.withColumn("_y", F.year("Date")).groupBy("_y")
                .agg(F.max_by("g", "Date").alias("_last")))
    earlier = Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    years = (u.select("_y").distinct().join(per_year, "_y", "left")
             .select("_y", F.last("_last", ignorenulls=True).over(earlier).alias("_carry")))
    return (u.select("Date", "src", "_y", F.last("g", ignorenulls=True).over(in_year).alias("_v"))
            .where(F.col("src") == 1)
            .join(years, "_y", "left")
            .select("Date", F.coalesce(F.col("_v"), F.col("_carry")).alias("vix_close")))


def daily_frame(bars: DataFrame, gauge: DataFrame | None) -> DataFrame:
    """X0 plus the gauge: cleaned bars with candle keys and the as-of gauge close."""
    df = drop_missing_close(bars).select("ticker", "Date", "Open", "High", "Low", "Close", "Volume",
                   week_id(F.col("Date")).alias("week_id"),
                   month_id(F.col("Date")).alias("month_id"))
    if gauge is None:
        return df.withColumn("vix_close", F.lit(None).cast("double"))
    return df.join(gauge_asof(df, gauge), "Date", "left")


def _d(v: float) -> str:
    return f"{float(v)!r}D"


def _div(a: str, b: str) -> str:
    return f"try_divide({a}, {b})"


def _clip0(x: str) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN 0.0D ELSE ({x}) END)"


def _rsi(g: str, l: str) -> str:
    return (f"(CASE WHEN ({g}) IS NULL OR ({l}) IS NULL THEN CAST(NULL AS DOUBLE) "
            f"WHEN ({l}) = 0 AND ({g}) = 0 THEN CAST(NULL AS DOUBLE) WHEN ({l}) = 0 THEN 100.0D "
            f"ELSE 100.0D - 100.0D / (1.0D + ({g}) / ({l})) END)")


def _pct(cur: str, prev: str) -> str:
    return f"((try_divide({cur}, {prev}) - 1.0D) * 100.0D)"


def candle_sums(daily: DataFrame, horizon: str) -> DataFrame:
    """One row per (ticker, candle): last close and gauge, volume, low and high of the daily rows given."""
    pid, _ = HORIZON_KEYS[horizon]
    last_non_null = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("Date")))
    return daily.groupBy("ticker", pid).agg(
        last_non_null("Close").alias("pc"),
        F.coalesce(F.sum("Volume"), F.lit(0.0)).alias("pv"),
        F.min("Low").alias("pl"),
        F.max("High").alias("ph"),
        last_non_null("vix_close").alias("pg"),
    )


def _seeded(stored: str, fresh: str, seeded: bool) -> str:
    """The input of a recurrence: a seed row enters with the value it had reached."""
    return f"(CASE WHEN _seed THEN {stored} ELSE {fresh} END)" if seeded else fresh


def candle_recurrences(sums: DataFrame, horizon: str, periods: Sequence[int], seeded: bool = False) -> DataFrame:
    """Return, averages and RSI of each candle as if closed.

    With ``seeded``, rows marked ``_seed`` (the last known candle of a ticker)
    carry their own columns as ``<name>_0`` and start the recurrences.
    """
    pid, _ = HORIZON_KEYS[horizon]
    keys = ("ticker",)
    prev = lambda x: shift_sql(x, keys, pid)
    chg = f"(pc - {prev('pc')})"
    g = sums.selectExpr("*", f"{_pct('pc', prev('pc'))} AS pret", f"{_clip0(chg)} AS gain", f"{_clip0('-' + chg)} AS loss")
    specs = [(f"ema{p}", _seeded(f"ema{p}_0", "pc", seeded), span_alpha(p)) for p in periods]
    specs += [("G", _seeded("G_0", "gain", seeded), RSI_ALPHA), ("L", _seeded("L_0", "loss", seeded), RSI_ALPHA)]
    g = ewm_mean(g, specs, keys, pid)
    return g.selectExpr("*", f"{_rsi('G', 'L')} AS crsi")


def candle_lookups(candles: DataFrame, horizon: str, periods: Sequence[int]) -> DataFrame:
    """What a daily row of candle k needs from candle k-1 and earlier: previous
    close, return, volume, low, high, gauge and averages, sums of the previous
    closes and of closed RSIs."""
    pid, short = HORIZON_KEYS[horizon]
    keys, o = ("ticker",), pid
    prev = lambda x: shift_sql(x, keys, o)
    closed = lambda x, n: rolling_sql("sum", x, keys, o, n, start=-n, end=-1)
    out = ["ticker", pid,
           f"{prev('pc')} AS {short}_pc_prev", f"{prev('pret')} AS {short}_ret_prev",
           f"{prev('pv')} AS {short}_pv_prev", f"{prev('pl')} AS {short}_pl_prev",
           f"{prev('ph')} AS {short}_ph_prev", f"{prev('pg')} AS {short}_pg_prev",
           f"{prev('G')} AS {short}_G_prev", f"{prev('L')} AS {short}_L_prev",
           f"{closed('crsi', RSI_MA_LENGTH - 1)} AS {short}_crsi_sum",
           f"{closed('pc', BB_PERIOD - 1)} AS {short}_bb_sum",
           f"{closed('pc * pc', BB_PERIOD - 1)} AS {short}_bb_sq"]
    for p in periods:
        out.append(f"{closed('pc', p - 1)} AS {short}_sum{p}")
        out.append(f"{prev(f'ema{p}')} AS {short}_ema{p}_prev")
    return candles.selectExpr(*out)


def period_table(daily: DataFrame, horizon: str, periods: Sequence[int]) -> DataFrame:
    """Closed-candle statistics of one horizon, one row per (ticker, candle)."""
    return candle_lookups(candle_recurrences(candle_sums(daily, horizon), horizon, periods), horizon, periods)


def daily_recurrences(daily: DataFrame, periods: Sequence[int], averages: bool = True, rsi: bool = True, seeded: bool = False) -> DataFrame:
    """Previous close, averages, Wilder averages and RSI of every daily row; seeds as in ``candle_recurrences``."""
    keys = ("ticker",)
    prev = lambda x: shift_sql(x, keys, "Date")
    chg = f"(Close - {prev('Close')})"
    df = daily.selectExpr("*", f"{prev('Close')} AS _prev_close",
                          f"{_clip0(chg)} AS _gain", f"{_clip0('-' + chg)} AS _loss")
    specs = []
    if averages:
        specs += [(f"_ema{p}", _seeded(f"_ema{p}_0", "Close", seeded), span_alpha(p)) for p in periods]
    if rsi:
        specs += [("_G", _seeded("_G_0", "_gain", seeded), RSI_ALPHA), ("_L", _seeded("_L_0", "_loss", seeded), RSI_ALPHA)]
    if specs:
        df = ewm_mean(df, specs, keys, "Date")
    extra = [f"CAST(NULL AS DOUBLE) AS {c}" for c in ("_G", "_L") if c not in df.columns]
    return df.selectExpr("*", *extra).selectExpr("*", f"{_rsi('_G', '_L')} AS _rsi")


def _candle_columns(horizon: str, periods: Sequence[int], series: Sequence[str] = ("ticker",)) -> dict[str, str]:
    """Daily-row expressions of one horizon (the open candle folded into the
    closed-candle statistics joined from ``period_table``)."""
    pid, s = HORIZON_KEYS[horizon]
    word = "weekly" if horizon == "weekly" else "monthly"
    keys = (*series, pid)
    c = lambda n: f"{s}_{n}"
    whole = over_sql(keys, "Date", frame_sql(None, None))
    cand_open = f"first(Open, true) {whole}"
    cols: dict[str, str] = {}
    cols[f"close_{word}_last"] = c("pc_prev")
    cols[f"pct_change_{s}_current"] = f"({_div(f'Close - {cand_open}', cand_open)} * 100.0D)"
    cols[f"pct_change_{s}_prev"] = c("ret_prev")
    for p in periods:
        cols[f"sma_{word}_{p}"] = f"(({c(f'sum{p}')} + Close) / {_d(p)})"
    for p in periods:
        a = span_alpha(p)
        cols[f"ema_{word}_{p}"] = f"({_d(a)} * Close + {_d(1.0 - a)} * {c(f'ema{p}_prev')})"
    cols[f"volume_{s}_current"] = running_sql("sum", "Volume", keys, "Date")
    cols[f"volume_{s}_prev"] = c("pv_prev")
    cols[f"low_{s}_current"] = running_sql("min", "Low", keys, "Date")
    cols[f"high_{s}_current"] = running_sql("max", "High", keys, "Date")
    cols[f"low_{s}_prev"] = c("pl_prev")
    cols[f"high_{s}_prev"] = c("ph_prev")
    basis = f"(({c('bb_sum')} + Close) / {_d(BB_PERIOD)})"
    var = f"(({c('bb_sq')} + Close * Close) / {_d(BB_PERIOD)} - {basis} * {basis})"
    std = f"sqrt({_clip0(var)})"
    cols[f"bb_base_{word}"] = basis
    cols[f"bb_upper_{word}"] = f"({basis} + {_d(BB_K)} * {std})"
    cols[f"bb_lower_{word}"] = f"({basis} - {_d(BB_K)} * {std})"
    chg = f"(Close - {c('pc_prev')})"
    gain = f"({_d(RSI_ALPHA)} * {_clip0(chg)} + {_d(1.0 - RSI_ALPHA)} * {c('G_prev')})"
    loss = f"({_d(RSI_ALPHA)} * {_clip0('-' + chg)} + {_d(1.0 - RSI_ALPHA)} * {c('L_prev')})"
    rsi = _rsi(gain, loss)
    rsi_ma = f"(({c('crsi_sum')} + {rsi}) / {_d(RSI_MA_LENGTH)})"
    cols[f"rsi_{word}"] = rsi
    cols[f"rsi_ma_{word}"] = rsi_ma
    cols[f"rsi_gap_{word}"] = f"({rsi} - {rsi_ma})"
    cols[f"vix_{word}_last"] = c("pg_prev")
    return cols


def _catalogue(periods: Sequence[int]) -> list[str]:
    """Output column order (the reference's block order X1..X8)."""
    names = ["close_daily_last", "pct_change_daily_last",
             "close_weekly_last", "pct_change_week_current", "pct_change_week_prev",
             "close_monthly_last", "pct_change_month_current", "pct_change_month_prev"]
    for p in periods:
        names += [f"sma_daily_{p}", f"sma_weekly_{p}", f"sma_monthly_{p}"]
    for p in periods:
        names += [f"ema_daily_{p}", f"ema_weekly_{p}", f"ema_monthly_{p}"]
    names += ["volume_prev_day", "volume_avg_daily_90",
              "volume_week_current", "volume_week_prev", "volume_month_current", "volume_month_prev"]
    names += ["low_prev_day", "high_prev_day",
              "low_week_current", "high_week_current", "low_week_prev", "high_week_prev",
              "low_month_current", "high_month_current", "low_month_prev", "high_month_prev"]
    for h in ("daily", "weekly", "monthly"):
        names += [f"bb_base_{h}", f"bb_upper_{h}", f"bb_lower_{h}"]
    for h in ("daily", "weekly", "monthly"):
        names += [f"rsi_{h}", f"rsi_ma_{h}", f"rsi_gap_{h}"]
    names += ["vix_daily_last", "vix_weekly_last", "vix_monthly_last"]
    return names


BLOCKS = {
    "returns": lambda n: n.startswith(("close_", "pct_change_")),
    "sma": lambda n: n.startswith("sma_"),
    "ema": lambda n: n.startswith("ema_"),
    "volume": lambda n: n.startswith("volume_"),
    "range": lambda n: n.startswith(("low_", "high_")),
    "bollinger": lambda n: n.startswith("bb_"),
    "rsi": lambda n: n.startswith("rsi_"),
    "vix": lambda n: n.startswith("vix_"),
}


def raw_features(bars: DataFrame, gauge: DataFrame | None,
                 periods: Sequence[int] = BACKEND_PERIODS,
                 start_date: str | None = None,
                 blocks: Sequence[str] | None = None,
                 columns: Sequence[str] | None = None,
                 block_rows: int | None = None) -> DataFrame:
    """All raw indicator columns for every ticker: ``Date, ticker, <catalogue>``.

    ``blocks`` restricts the output to some of X1..X8 (see ``BLOCKS``) and
    ``columns`` to named catalogue columns; the plan then only carries the
    windows, scans and period joins those columns need.  ``start_date`` trims
    rows (strict >) *after* all windows ran on the full history (B4).

    ``block_rows`` cuts each ticker's daily rows into blocks of so many (at
    least the longest frame) for the windows over daily rows, for series too
    long for one task; the results are the same.

    ``bars`` may be raw bars or a prepared ``daily_frame`` (for example one
    materialized and hash-partitioned by ticker), in which case ``gauge`` is
    not used again.
    """
    periods = tuple(int(p) for p in periods)
    if any(p < 2 for p in periods):
        raise ValueError("moving-average periods must be >= 2")
    wanted = [n for n in _catalogue(periods)
              if (blocks is None or any(BLOCKS[b](n) for b in blocks))
              and (columns is None or n in columns)]

    if {"week_id", "month_id", "vix_close"} <= set(bars.columns):
        daily = bars                      # already a prepared daily frame (see ``daily_frame``)
    else:
        daily = daily_frame(bars, gauge).repartition("ticker")
    df = daily_recurrences(daily, periods, any(n.startswith("ema_daily_") for n in wanted),
                           any(n.startswith("rsi_") and n.endswith("daily") for n in wanted))
    out = indicator_rows(df, lambda h: period_table(daily, h, periods), periods, wanted, block_rows)
    if start_date is not None:
        out = trim_to_start(out, start_date)
    return out


#: Daily rows that a row's open candle can reach to either side, at most a month's days.
CANDLE_ROWS = 31


def longest_frame(periods: Sequence[int]) -> int:
    """Daily rows before a row that its rolling frames and its open month reach back to."""
    return max(*periods, VOLUME_AVG_WINDOW, BB_PERIOD, RSI_MA_LENGTH, CANDLE_ROWS + 1)


def indicator_rows(df: DataFrame, lookups, periods: Sequence[int], wanted: Sequence[str], block_rows: int | None = None) -> DataFrame:
    """The ``wanted`` catalogue columns of daily rows that have their recurrences;
    ``lookups(horizon)`` gives the table of ``candle_lookups``; blocks as in ``raw_features``."""
    keys: tuple[str, ...] = ("ticker",)
    if block_rows is not None:
        reach = longest_frame(periods)
        df = blocked(df, keys, "Date", max(block_rows, reach), reach, CANDLE_ROWS)
        keys = ("ticker", "__block")
        df = df.drop("_prev_close").selectExpr("*", f"{shift_sql('Close', keys, 'Date')} AS _prev_close")
    prev = lambda x: shift_sql(x, keys, "Date")
    cand = {h: _candle_columns(h, periods, keys) for h in HORIZON_KEYS}
    for h, (pid, _) in HORIZON_KEYS.items():
        if any(n in cand[h] for n in wanted):
            df = df.join(lookups(h), ["ticker", pid], "left")

    roll = lambda agg, x, n: rolling_sql(agg, x, keys, "Date", n)
    cols: dict[str, str] = {
        "close_daily_last": "Close",
        "pct_change_daily_last": _pct("Close", "_prev_close"),
    }
    for p in periods:
        cols[f"sma_daily_{p}"] = roll("avg", "Close", p)
        cols[f"ema_daily_{p}"] = f"_ema{p}"
    cols["volume_prev_day"] = prev("Volume")
    cols["volume_avg_daily_90"] = roll("avg", "Volume", VOLUME_AVG_WINDOW)
    cols["low_prev_day"] = prev("Low")
    cols["high_prev_day"] = prev("High")
    base, sd = roll("avg", "Close", BB_PERIOD), roll("stddev_pop", "Close", BB_PERIOD)
    cols["bb_base_daily"] = base
    cols["bb_upper_daily"] = f"({base} + {_d(BB_K)} * {sd})"
    cols["bb_lower_daily"] = f"({base} - {_d(BB_K)} * {sd})"
    rsi_ma = roll("avg", "_rsi", RSI_MA_LENGTH)
    cols["rsi_daily"] = "_rsi"
    cols["rsi_ma_daily"] = rsi_ma
    cols["rsi_gap_daily"] = f"(_rsi - {rsi_ma})"
    cols["vix_daily_last"] = prev("vix_close")
    for h in HORIZON_KEYS:
        cols.update(cand[h])
    own = [] if block_rows is None else ["__own"]
    out = df.selectExpr("Date", "ticker", *own, *[f"CAST({cols[n]} AS DOUBLE) AS {n}" for n in wanted])
    return out.where("__own").drop("__own") if own else out


def trim_to_start(features: DataFrame, start_date: str | None = DEFAULT_START) -> DataFrame:
    """Keep rows strictly after the cutoff (default 2000-01-01).  Applied
    above the windows, so the indicators still see the full history."""
    cutoff = str(start_date or DEFAULT_START)[:10]
    return features.where(F.col("Date") > F.to_date(F.lit(cutoff)))
