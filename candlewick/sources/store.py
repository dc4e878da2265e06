"""Per-horizon indicator store and stage hand-off.

The store is three tables (daily, weekly, monthly), each keyed by (ticker,
Date), and the state from which they are advanced (``operators.incremental``).
All of them are partitioned by year and ticker bucket and change together, by
one commit of ``versions``: a sync writes the partitions from the first new bar
on and reads the state before it, not the history.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import HORIZONS, known_horizon
from ..operators import incremental
from ..operators.features import split_by_horizon
from ..operators.indicators import BACKEND_PERIODS, HORIZON_KEYS, trim_to_start
from ..session import written
from . import versions

KEYS = ("ticker", "Date")


def store_columns(periods: Sequence[int] = BACKEND_PERIODS) -> dict[str, list[str]]:
    """Column lists of the three store tables for the given MA periods (fixed values)."""
    ma = lambda kind, h: [f"{kind}_{h}_{p}" for p in periods]
    return {
        "daily": ["close_daily_last", "pct_change_daily_last", *ma("sma", "daily"), *ma("ema", "daily"),
                  "volume_prev_day", "volume_avg_daily_90", "low_prev_day", "high_prev_day",
                  "bb_base_daily", "bb_upper_daily", "bb_lower_daily",
                  "rsi_daily", "rsi_ma_daily", "rsi_gap_daily", "vix_daily_last"],
        "weekly": ["close_weekly_last", "pct_change_week_current", "pct_change_week_prev",
                   *ma("sma", "weekly"), *ma("ema", "weekly"),
                   "volume_week_current", "volume_week_prev",
                   "low_week_current", "high_week_current", "low_week_prev", "high_week_prev",
                   "bb_base_weekly", "bb_upper_weekly", "bb_lower_weekly",
                   "rsi_weekly", "rsi_ma_weekly", "rsi_gap_weekly", "vix_weekly_last"],
        "monthly": ["close_monthly_last", "pct_change_month_current", "pct_change_month_prev",
                    *ma("sma", "monthly"), *ma("ema", "monthly"),
                    "volume_month_current", "volume_month_prev",
                    "low_month_current", "high_month_current", "low_month_prev", "high_month_prev",
                    "bb_base_monthly", "bb_upper_monthly", "bb_lower_monthly",
                    "rsi_monthly", "rsi_ma_monthly", "rsi_gap_monthly", "vix_monthly_last"],
    }


def store_schema(horizon: str, periods: Sequence[int] = BACKEND_PERIODS) -> T.StructType:
    """Key columns + DOUBLE value columns of one horizon table."""
    cols = store_columns(periods)[known_horizon(horizon)]
    return T.StructType([T.StructField("ticker", T.StringType(), False),
                         T.StructField("Date", T.DateType(), False)]
                        + [T.StructField(c, T.DoubleType()) for c in cols])


def normalize_ticker(t):
    """B18: '.' -> '_', '^' removed (storage-safe ticker name)."""
    return F.regexp_replace(F.regexp_replace(t, r"\.", "_"), r"\^", "")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that its scheme names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def init_tables(spark: SparkSession, root: str, buckets: int = versions.BUCKETS) -> None:
    """Make the empty tables where there are none; tables that are there keep their rows and their buckets."""
    held = versions.latest(spark, root)
    if not held.number:
        held = versions.Version(root, buckets=buckets)
    missing = {t: {} for t in (*HORIZONS, *STATE_TABLES) if t not in held.tables}
    if missing:
        versions.commit(spark, held, missing)


def open_store(spark: SparkSession, root: str, periods: Sequence[int] = BACKEND_PERIODS, number: int | None = None) -> dict[str, DataFrame]:
    """The three tables at one version, the newest or the given one: later commits do not change what they read."""
    held = versions.latest(spark, root) if number is None else versions.at(spark, root, number)
    return {h: held.read(spark, h, store_schema(h, periods)) for h in HORIZONS}


def write_horizons(tables: dict[str, DataFrame], root: str, periods: Sequence[int] = BACKEND_PERIODS) -> versions.Version:
    """A11 (write half): replace all rows of the tickers that the tables hold, in one commit.

    Their kept state goes with their rows: the next sync computes it anew.
    """
    spark = next(iter(tables.values())).sparkSession
    base = versions.latest(spark, root)
    tables = {h: written(t, f"replace-{h}") for h, t in tables.items()}
    named = _union_all([t.select("ticker") for t in tables.values()]).distinct()
    buckets = {r[0] for r in named.select(base.bucket(F.col("ticker"))).distinct().collect()}
    changes = {}
    for table in (*HORIZONS, *STATE_TABLES):
        schema, year = _layout(table, periods)
        if table in HORIZONS and table not in tables:
            continue
        old = base.read(spark, table, schema, lambda y, b: b in buckets).join(named, "ticker", "left_anti")
        rows = old.unionByName(tables[table].select(*schema.fieldNames())) if table in tables else old
        gone = {part: None for part in base.tables.get(table, {}) if part[1] in buckets}
        changes[table] = gone | versions.write_partitions(rows, base, table, year)
    return versions.commit(spark, base, changes)


def project_horizons(features: DataFrame, periods: Sequence[int] = BACKEND_PERIODS) -> dict[str, DataFrame]:
    """A11 (projection half): available columns of each store table, missing -> NULL."""
    cols = store_columns(periods)
    parts = split_by_horizon(features, keys=("Date", "ticker"))
    out = {}
    for h in HORIZONS:
        have = set(parts[h].columns)
        out[h] = features.select(
            "ticker", "Date",
            *[(F.col(c) if c in have else F.lit(None).cast("double")).alias(c) for c in cols[h]])
    return out


def upsert(table: DataFrame, delta: DataFrame, keys: Sequence[str] = KEYS, latest_by: Sequence[str] = ()) -> DataFrame:
    """A10: keyed merge, the delta wins on equal keys; columns missing on either
    side are NULL.  Idempotent: merging the same delta twice changes nothing.

    Of the delta's rows that share a key the one with the largest ``latest_by``
    values wins, compared in turn, nulls lowest; what is still equal (or without
    ``latest_by``) is decided by the other columns' values, largest first, so
    the winner never depends on the order in which rows arrive.
    """
    new = latest_rows(delta, keys, latest_by)
    return table.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def latest_rows(delta: DataFrame, keys: Sequence[str], latest_by: Sequence[str] = ()) -> DataFrame:
    """One row per key, as ``upsert`` chooses it; the ``latest_by`` columns are dropped."""
    rest = [c for c in delta.columns if c not in keys and c not in latest_by]
    if not rest:
        return delta.select(*keys).distinct()
    best = F.max(F.struct(*latest_by, F.struct(*rest).alias("_winner"))).alias("_best")
    return delta.groupBy(*keys).agg(best).select(*keys, "_best._winner.*").select(*[c for c in delta.columns if c not in latest_by])


#: State beside the horizon tables: daily rows and candles with their recurrences, and marks that tell how far back to read.
STATE_TABLES = ("daily_state", "weekly_state", "monthly_state", "marks")


def _layout(table: str, periods: Sequence[int]) -> tuple[T.StructType, F.Column]:
    """Schema of a stored table and the year that its rows are filed under; candles and marks are few and filed under 0."""
    if table in HORIZONS:
        return store_schema(table, periods), F.year("Date")
    if table == "daily_state":
        return incremental.daily_state_schema(periods), F.year("Date")
    if table == "marks":
        return incremental.MARK_SCHEMA, F.lit(0)
    return incremental.candle_state_schema(table.removesuffix("_state"), periods), F.lit(0)


def _union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_state(spark: SparkSession, held: versions.Version, new: DataFrame, periods: Sequence[int] = BACKEND_PERIODS) -> incremental.State:
    """The state of the tickers in ``new`` before their first row there, and what is kept after it.

    The marks of the years before tell from which year on each bucket's daily
    rows are needed; older partitions are neither listed nor read.
    """
    first = new.groupBy("ticker").agg(F.min("Date").alias("_from"))
    marks = held.read(spark, "marks", incremental.MARK_SCHEMA).join(first, "ticker", "right").where(
        F.col("in_year").isNull() | (F.col("in_year") <= F.year("_from")))
    # A mark of the year itself may lie after the first new bar; the one before bounds its reach from below.
    reach = marks.groupBy("ticker", "_from").agg(
        F.max_by("halo_from", F.when(F.col("in_year") < F.year("_from"), F.col("in_year"))).alias("reach"))
    start = reach.groupBy(held.bucket(F.col("ticker")).alias("bucket")).agg(F.min(F.year(F.coalesce("reach", "_from"))).alias("year"))
    since = {r["bucket"]: r["year"] for r in start.collect()}  # one row a bucket
    daily = held.read(spark, "daily_state", incremental.daily_state_schema(periods), lambda y, b: y >= since.get(b, 1 << 30))
    candles = {h: held.read(spark, f"{h}_state", incremental.candle_state_schema(h, periods), lambda y, b: b in since) for h in HORIZON_KEYS}
    return incremental.State(daily, candles)


def apply_bars(spark: SparkSession, root: str, new: DataFrame, periods: Sequence[int] = BACKEND_PERIODS,
               batch: tuple[str, int] | None = None, default_start: str | None = None) -> versions.Version:
    """Bring state and tables up to ``new``, daily rows that are new or corrected, in one commit.

    One row per (ticker, Date) is taken (see ``upsert``). With a
    ``default_start`` the tables hold later dates only; the state holds all.
    ``batch`` (stream, number) makes a replay of the same or an earlier batch a
    no-op. A failure before the commit changes nothing that a reader sees.
    """
    init_tables(spark, root)
    base = versions.latest(spark, root)
    if base.has_batch(batch):
        return base
    new = written(latest_rows(new, KEYS), "new-bars")
    if new.isEmpty():
        return versions.commit(spark, base, {}, batch) if batch else base
    done = incremental.advance(new, read_state(spark, base, new, periods), periods)
    features = trim_to_start(done.features, default_start) if default_start else done.features
    rows = {**project_horizons(features, periods), "daily_state": done.daily, "marks": done.marks,
            **{f"{h}_state": c for h, c in done.candles.items()}}
    key = {"weekly_state": ("week_id", "_week"), "monthly_state": ("month_id", "_month"), "marks": ("in_year", "_year")}
    first = done.first.withColumn("_year", F.year("_from"))

    def replace(table: str) -> dict:
        """The table's partitions that get new rows: what they held before the first new row of each ticker, and the new rows."""
        schema, year = _layout(table, periods)
        column, start = key.get(table, ("Date", "_from"))
        own = rows[table].select(*schema.fieldNames())
        touched = {tuple(r) for r in own.select(year.cast("int"), base.bucket(F.col("ticker"))).distinct().collect()}
        old = base.read(spark, table, schema, lambda y, b: (y, b) in touched).join(first.select("ticker", start), "ticker", "left").where(
            F.col(start).isNull() | (F.col(column) < F.col(start))).drop(start)
        return versions.write_partitions(old.unionByName(own), base, table, year)

    with ThreadPoolExecutor(max_workers=len(rows)) as pool:
        changes = dict(zip(rows, pool.map(replace, rows)))
    return versions.commit(spark, base, changes, batch)


def sync_store(spark: SparkSession, root: str, daily: DataFrame, periods: Sequence[int] = BACKEND_PERIODS,
               default_start: str | None = None) -> versions.Version:
    """D7 in one batch: apply the rows of ``daily`` after the last date that all three tables of a ticker hold.

    Synced tickers cost nothing; one whose state is missing is computed from its first bar.
    """
    init_tables(spark, root)
    held = versions.latest(spark, root)
    status = sync_status(daily, open_store(spark, root, periods))
    known = held.read(spark, "marks", incremental.MARK_SCHEMA).select("ticker").distinct()
    stale = status.where(~F.col("is_synced")).join(known.withColumn("_known", F.lit(True)), "ticker", "left").select(
        "ticker", F.when(F.col("_known"), F.col("db_latest")).alias("_after"))
    new = daily.join(stale, "ticker").where(F.col("_after").isNull() | (F.col("Date") > F.col("_after"))).drop("_after")
    return apply_bars(spark, root, new, periods, default_start=default_start)


def read_horizon(store: dict[str, DataFrame], horizon: str, start_date: str | None = None,
                 ticker: str | None = None) -> DataFrame:
    """A8 + A13: one horizon table, optional ``Date >= start`` (pushed to the
    scan) and ticker partition filter, ordered by date at the sink."""
    df = store[known_horizon(horizon)]
    if ticker is not None:
        df = df.where(F.col("ticker") == ticker)
    if start_date:
        df = df.where(F.col("Date") >= F.to_date(F.lit(start_date)))
    return df.orderBy("ticker", "Date")


def unknown_tickers(requested: DataFrame, store_daily: DataFrame) -> DataFrame:
    """Requested tickers absent from the store (left anti join on the
    small distinct ticker lists)."""
    return requested.select("ticker").distinct().join(store_daily.select("ticker").distinct(), "ticker", "left_anti")


def known_tickers(requested: DataFrame, store_daily: DataFrame, named: int = 10) -> DataFrame:
    """The distinct requested tickers; raises a KeyError that names some of those the store does not hold."""
    missing = [r.ticker for r in unknown_tickers(requested, store_daily).orderBy("ticker").limit(named + 1).collect()]
    if missing:
        more = " and more" if len(missing) > named else ""
        raise KeyError(f"no such ticker in the store: {', '.join(map(str, missing[:named]))}{more}")
    return requested.select("ticker").distinct()


def as_records(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows as (keys, struct of features) snapshot records."""
    feats = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.struct(*feats).alias("features"))


def latest_dates(store: dict[str, DataFrame]) -> DataFrame:
    """MAX(Date) per ticker and horizon."""
    out = None
    for h in HORIZONS:
        part = store[h].groupBy("ticker").agg(F.max("Date").alias("latest_date")) \
            .withColumn("horizon", F.lit(h))
        out = part if out is None else out.unionByName(part)
    return out.select("ticker", "horizon", "latest_date")


def sync_status(source_bars: DataFrame, store: dict[str, DataFrame]) -> DataFrame:
    """D6 (J5 + B14): source-latest vs store-latest per ticker.

    The store's date is the least of its tables' latest ones, null if a table
    lacks the ticker; synced only when both sides exist and are the same day.
    """
    src = source_bars.groupBy("ticker").agg(F.max("Date").alias("source_latest"))
    latest = _union_all([t.groupBy("ticker").agg(F.max("Date").alias("_last")) for t in store.values()])
    db = latest.groupBy("ticker").agg(F.when(F.count("*") == len(store), F.min("_last")).alias("db_latest"))
    synced = F.coalesce(F.col("source_latest") == F.col("db_latest"), F.lit(False))
    return src.join(db, "ticker", "left").select("ticker", "source_latest", "db_latest", synced.alias("is_synced"))


def retrain_flag(trained_through: DataFrame, bars: DataFrame, horizon_key) -> DataFrame:
    """Retraining is due when the models' last trained date is older than
    the newest *closed* candle of the data.

    trained_through: (horizon, last_trained_through).  horizon_key(h) gives the
    candle id column expression of a horizon over ``Date``.
    """
    ids = bars.select("ticker", "Date", *[horizon_key(h).alias(f"_{h}") for h in HORIZONS])
    last = Window.partitionBy("ticker")
    ids = ids.select("Date", *[F.when(F.col(f"_{h}") < F.max(f"_{h}").over(last), F.col("Date")).alias(h) for h in HORIZONS])
    closed = ids.agg(*[F.max(h).alias(h) for h in HORIZONS]).unpivot([], list(HORIZONS), "horizon", "latest_closed")
    flag = F.coalesce(F.col("last_trained_through") < F.col("latest_closed"), F.lit(True))
    return closed.join(trained_through, "horizon", "left").select(
        "horizon", "last_trained_through", "latest_closed", flag.alias("retrain_needed"))


# ---------------------------------------------------------------- stage hand-off
def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite only the partitions present in ``df`` (dynamic overwrite)."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_stage(spark: SparkSession, path: str, **partition_values) -> DataFrame:
    """Read a stage table; equality filters on partition columns prune folders."""
    df = spark.read.parquet(path)
    for k, v in partition_values.items():
        df = df.where(F.col(k) == v)
    return df


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Report tables, latest run only."""
    w = df.write.mode("overwrite")
    (w.option("header", "true").csv(path) if fmt == "csv" else w.json(path))
