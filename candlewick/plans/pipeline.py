"""Stage builders: each returns a lazy DataFrame from the driver's tables.

    lineitem -> bars ----\\
    orders   -> gauge ----> raw indicators -> pooled -> horizon raw
                                   -> features/labels -> split -> baseline -> metrics

Nothing here triggers an action except ``stage``: the stages read many times
(daily bars, features, split) are written once to the shared checkpoint folder.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import (HORIZON_TOKENS, drop_missing_anchor, engineer_horizon, pool_tickers,
                                  select_horizon_columns)
from ..operators.indicators import BACKEND_PERIODS, MODEL_PERIODS, daily_frame, raw_features
from ..operators.indicators import _catalogue as catalogue
from ..operators.labels import split_groups
from ..session import ensure_checkpoint_dir, scratch_path, session_key
from ..sources.bars import load_bars, load_gauge

HORIZONS = ("daily", "weekly", "monthly")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily bars, materialized once: what every branch reads instead of the line items."""
    return stage(spark, ("bars", sf_dir, *inputs(spark, sf_dir)), lambda: load_bars(spark, sf_dir))


_LISTED: dict[tuple, tuple] = {}
_LISTING = {"depth": 0}
_LIST_GUARD = threading.Lock()


@contextlib.contextmanager
def one_listing():
    """Within it the input files are listed once, however many stages a query asks for."""
    with _LIST_GUARD:
        _LISTING["depth"] += 1
    try:
        yield
    finally:
        with _LIST_GUARD:
            _LISTING["depth"] -= 1
            if not _LISTING["depth"]:
                _LISTED.clear()


def inputs(spark: SparkSession, sf_dir: str) -> tuple:
    """A digest of path, size and time of every input file: a stage is built anew when they change.

    One call per folder level and table, whose whole listing comes back as one string.
    """
    key = (session_key(spark), sf_dir)
    with _LIST_GUARD:
        if key in _LISTED:
            return _LISTED[key]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    digest = hashlib.sha256()
    for name in ("lineitem", "orders"):
        pattern = os.path.join(sf_dir, f"{name}.parquet")
        while True:
            path = jvm.org.apache.hadoop.fs.Path(pattern)
            found = path.getFileSystem(conf).globStatus(path)
            if not found:
                break
            digest.update(jvm.scala.runtime.ScalaRunTime.stringOf(found).encode())
            pattern = os.path.join(pattern, "*")
    out = (digest.hexdigest(),)
    with _LIST_GUARD:
        if _LISTING["depth"]:
            _LISTED[key] = out
    return out


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_gauge(spark, sf_dir)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars + candle keys + as-of gauge, materialized once: the scan and
    aggregation of the line items run a single time however many indicator
    branches read the result (calendar-sized: one row per ticker and day)."""
    return stage(spark, ("daily", sf_dir, *inputs(spark, sf_dir)),
                 lambda: daily_frame(bars(spark, sf_dir), gauge(spark, sf_dir)).repartition("ticker"))


def raw(spark: SparkSession, sf_dir: str, periods: Sequence[int] = BACKEND_PERIODS,
        blocks: Sequence[str] | None = None, start_date: str | None = None, block_rows: int | None = None) -> DataFrame:
    return raw_features(daily(spark, sf_dir), None, periods, start_date, blocks, block_rows=block_rows)


def pooled(spark: SparkSession, sf_dir: str, periods: Sequence[int] = MODEL_PERIODS) -> DataFrame:
    return pool_tickers(raw(spark, sf_dir, periods))


def horizon_raw(spark: SparkSession, sf_dir: str, horizon: str, periods: Sequence[int] = MODEL_PERIODS) -> DataFrame:
    """Extract (B2) + missing check (B7) for one horizon.  Only the columns
    of that horizon (and the daily close behind the anchor) are computed."""
    toks = HORIZON_TOKENS[horizon]
    cols = ["close_daily_last"] + [c for c in catalogue(periods) if any(t in c for t in toks)]
    raw_h = raw_features(daily(spark, sf_dir), None, periods, columns=cols)
    return drop_missing_anchor(select_horizon_columns(pool_tickers(raw_h), horizon))


_STAGES: dict[tuple, object] = {}
_LOCKS: dict[tuple, threading.Lock] = {}
_GUARD = threading.Lock()
STAGE_MODE = os.environ.get("CANDLEWICK_STAGE_MODE", "parquet")   # or "checkpoint"


def stage(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Materialize a stage that later stages read several times.

    Default: a parquet table in the shared folder named by
    ``spark.checkpoint.dir``, so that readers get column pruning and filter
    pushdown; with CANDLEWICK_STAGE_MODE=checkpoint a reliable ``checkpoint()``
    there, which keeps the partitioning.  Either way the lineage is cut, so a lost
    executor never recomputes the upstream scan, and the stage is built once
    per session and key; ``clear_stages()`` forgets the handles.
    """
    return once(spark, key, lambda: _build_stage(spark, build))


def once(spark: SparkSession, key: tuple, build):
    """The result of ``build``, called the first time that a key is asked for in a session."""
    full = (session_key(spark), *key)
    with _GUARD:
        lock = _LOCKS.setdefault(full, threading.Lock())
    with lock:                        # concurrent callers of one stage wait for a single build
        hit = _STAGES.get(full)
        if hit is None:
            hit = build()
            _STAGES[full] = hit
    return hit


def _build_stage(spark: SparkSession, build) -> DataFrame:
    if STAGE_MODE == "checkpoint":
        ensure_checkpoint_dir(spark)
        return build().checkpoint(eager=True)
    path = scratch_path(spark, f"stages/{uuid.uuid4().hex}")
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def clear_stages() -> None:
    _STAGES.clear()


def features(spark: SparkSession, sf_dir: str, horizon: str, periods: Sequence[int] = MODEL_PERIODS) -> DataFrame:
    """Engineered table of one horizon (materialized: read by the split,
    folds, EDA and fits; calendar-sized, one row per ticker and trading day)."""
    key = ("features", sf_dir, horizon, tuple(periods), *inputs(spark, sf_dir))
    return stage(spark, key, lambda: engineer_horizon(horizon_raw(spark, sf_dir, horizon, periods), horizon, periods)[0])


def split(spark: SparkSession, sf_dir: str, horizon: str, periods: Sequence[int] = MODEL_PERIODS) -> DataFrame:
    """Train/test tagged rows (materialized, read by every modelling stage)."""
    key = ("split", sf_dir, horizon, tuple(periods), *inputs(spark, sf_dir))
    return stage(spark, key, lambda: split_groups(features(spark, sf_dir, horizon, periods), horizon))


def all_horizons(fn, *args) -> DataFrame:
    """Union of one stage over the three horizons with a ``horizon`` column.

    The three per-horizon plans are built in parallel driver threads: building
    them materializes their stages (Spark jobs), and concurrent jobs share the
    executors instead of queueing behind each other's small stages.
    """
    with ThreadPoolExecutor(max_workers=len(HORIZONS)) as pool:
        parts = list(pool.map(lambda h: fn(h, *args).withColumn("horizon", F.lit(h)), HORIZONS))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
