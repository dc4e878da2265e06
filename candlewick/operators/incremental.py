"""Indicators of new and corrected bars from a kept state, without the bars before it.

The state of a ticker at a daily row is what later rows need from it: the row
itself with its exponential and Wilder averages and RSI, the rows of the longest
rolling frame before it, and its weekly and monthly candles with theirs. It is
kept row by row (``daily_state``) and candle by candle (``weekly_state``,
``monthly_state``), so that the state before any date is at hand: a corrected
bar rolls its ticker back to the row before it.

``advance`` continues the recurrences from the last row (candle) before the
first new bar, and recomputes the candle that is open there from its rows. All
of it is the code of the full computation, run on the kept rows and the new ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .indicators import (
    HORIZON_KEYS,
    _catalogue as catalogue,
    candle_lookups,
    candle_recurrences,
    candle_sums,
    daily_recurrences,
    indicator_rows,
    longest_frame,
)

BAR_COLUMNS = ("Open", "High", "Low", "Close", "Volume", "vix_close")


def daily_state_schema(periods: Sequence[int]) -> T.StructType:
    """A daily row with its recurrences; ``halo_from`` is the date ``longest_frame`` rows before it (the first if there are fewer)."""
    values = [*BAR_COLUMNS, *[f"_ema{p}" for p in periods], "_G", "_L", "_rsi"]
    return T.StructType([T.StructField("ticker", T.StringType()), T.StructField("Date", T.DateType()),
                         T.StructField("week_id", T.IntegerType()), T.StructField("month_id", T.IntegerType()),
                         *[T.StructField(c, T.DoubleType()) for c in values], T.StructField("halo_from", T.DateType())])


def candle_state_schema(horizon: str, periods: Sequence[int]) -> T.StructType:
    values = ["pc", "pv", "pl", "ph", "pg", "pret", *[f"ema{p}" for p in periods], "G", "L", "crsi"]
    return T.StructType([T.StructField("ticker", T.StringType()), T.StructField(HORIZON_KEYS[horizon][0], T.IntegerType()),
                         *[T.StructField(c, T.DoubleType()) for c in values]])


#: The last date of a ticker's year and how far back the state of that date reaches: which partitions to read.
MARK_SCHEMA = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("in_year", T.IntegerType()),
                            T.StructField("last", T.DateType()), T.StructField("halo_from", T.DateType())])


@dataclass
class State:
    """What is kept of the tickers to advance. ``daily`` must reach back to the halo of the last row before each
    ticker's first new bar, the candles to the longest frame before it."""

    daily: DataFrame
    candles: dict[str, DataFrame]


@dataclass
class Advance:
    """Rows from each ticker's first new bar on: state, candles (from the open one on), and indicators of all horizons."""

    first: DataFrame
    daily: DataFrame
    candles: dict[str, DataFrame]
    marks: DataFrame
    features: DataFrame


def _last_before(state: DataFrame, first: DataFrame, key: str, start: str) -> DataFrame:
    """The row of the largest ``key`` below ``start`` of every ticker in ``first``."""
    rest = [c for c in state.columns if c not in ("ticker", key)]
    before = state.join(first, "ticker").where(F.col(key) < F.col(start))
    best = before.groupBy("ticker").agg(F.max_by(F.struct(key, *rest), key).alias("r"))
    return best.select("ticker", "r.*")


def _as_seed(last: DataFrame, names: Sequence[str], pattern: Callable[[str], str]) -> DataFrame:
    """Rows that start the recurrences: their reached values renamed, the flag set."""
    return last.select(*[c for c in last.columns if c not in names], *[F.col(c).alias(pattern(c)) for c in names],
                       F.lit(True).alias("_seed"))


def advance(new: DataFrame, state: State, periods: Sequence[int]) -> Advance:
    """State and indicators of the rows from each ticker's first row in ``new`` on.

    ``new``: rows of a ``daily_frame``, one per (ticker, Date); they replace
    kept rows of their key, and kept rows after them are computed anew. A ticker
    without kept rows starts at its first bar.
    """
    periods = tuple(int(p) for p in periods)
    base = ["ticker", "Date", "week_id", "month_id", *BAR_COLUMNS]
    first = written(new.groupBy("ticker").agg(
        F.min("Date").alias("_from"), F.min("week_id").alias("_week"), F.min("month_id").alias("_month")), "first")
    kept = state.daily.join(first, "ticker")
    later = kept.where(F.col("Date") >= F.col("_from")).select(*base).join(new.select("ticker", "Date"), ["ticker", "Date"], "left_anti")
    rows = later.unionByName(new.select(*[F.col(c).cast(state.daily.schema[c].dataType) for c in base]))

    reached = [*[f"_ema{p}" for p in periods], "_G", "_L"]
    last = written(_last_before(state.daily, first.select("ticker", "_from"), "Date", "_from"), "last")
    seeds = _as_seed(last.drop("_rsi", "halo_from"), reached, lambda c: f"{c}_0")
    fed = seeds.unionByName(rows.withColumn("_seed", F.lit(False)), allowMissingColumns=True)
    computed = daily_recurrences(fed, periods, seeded=True).where("NOT _seed").select(*base, *reached, "_rsi")

    halo = kept.join(last.select("ticker", F.col("halo_from").alias("_reach")), "ticker").where(
        (F.col("Date") < F.col("_from")) & (F.col("Date") >= F.col("_reach")))
    halo = halo.select(*base, *reached, "_rsi").withColumn("_new", F.lit(False))
    together = halo.unionByName(computed.withColumn("_new", F.lit(True)))
    back = Window.partitionBy("ticker").orderBy("Date")
    reach = F.coalesce(F.lag("Date", longest_frame(periods)).over(back), F.first("Date").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    together = written(together.withColumns({"halo_from": reach, "_prev_close": F.lag("Close").over(back)}), "advanced")
    daily = together.where("_new").select(*daily_state_schema(periods).fieldNames())

    def one(h: str) -> tuple[DataFrame, DataFrame]:
        """The horizon's candles from the open one on, and what daily rows look up in them and in the earlier ones."""
        pid, start = HORIZON_KEYS[h][0], {"weekly": "_week", "monthly": "_month"}[h]
        values = [*[f"ema{p}" for p in periods], "G", "L"]
        own = first.select("ticker", start)
        earlier = state.candles[h].join(own, "ticker").where(F.col(pid) < F.col(start)).drop(start)
        seed = _as_seed(_last_before(state.candles[h], own, pid, start).drop("pret", "crsi"), values, lambda c: f"{c}_0")
        sums = candle_sums(together.join(own, "ticker").where(F.col(pid) >= F.col(start)), h)
        fed = seed.unionByName(sums.withColumn("_seed", F.lit(False)), allowMissingColumns=True)
        names = candle_state_schema(h, periods).fieldNames()
        new = written(candle_recurrences(fed, h, periods, seeded=True).where("NOT _seed").select(*names), f"{h}-candles")
        return new, candle_lookups(earlier.select(*names).unionByName(new), h, periods)

    with ThreadPoolExecutor(max_workers=len(HORIZON_KEYS)) as pool:
        made = dict(zip(HORIZON_KEYS, pool.map(one, HORIZON_KEYS)))
    candles, lookups = {h: m[0] for h, m in made.items()}, {h: m[1] for h, m in made.items()}
    features = indicator_rows(together, lookups.__getitem__, periods, catalogue(periods))
    features = features.join(first.select("ticker", "_from"), "ticker").where(F.col("Date") >= F.col("_from")).drop("_from")
    marks = daily.groupBy("ticker", F.year("Date").alias("in_year")).agg(F.max("Date").alias("last"), F.max_by("halo_from", "Date").alias("halo_from"))
    return Advance(first, daily, candles, marks, written(features, "features"))
