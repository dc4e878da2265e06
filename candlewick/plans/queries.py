"""Registered queries: name -> (spark, sf_dir) -> DataFrame (their DuckDB SQL
lives in ``oracle``).  Every query reads the driver's tables (lineitem,
orders) in full; double results are put on a comparison grid (float32, then
multiples of 2**-20) so both engines compare equal despite different
summation orders."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import candle_part, period_id
from ..functions.numeric import GRID
from ..operators import decide, eda, evaluate, sampling
from ..operators.features import (
    align_to,
    drop_missing_anchor,
    ANCHOR,
    HORIZON_SPEC,
    REALIZED_VOL_WINDOW,
    SHARED_COLUMNS,
    engineered_columns,
    history_filter,
    non_finite_to_null,
    numeric_columns,
    removed_counts,
    select_horizon_columns,
    snapshot_validation,
    union_tables,
)
from ..operators.ranges import asof_join, series_windows
from ..operators.quantreg import fit_lines
from ..operators.forest import WEIGHT_STEPS, QuantileForest, best_trees, curve_summary, fit_forest, learning_curve
from ..operators.indicators import BACKEND_PERIODS, MODEL_PERIODS
from ..operators.information import knn_information
from ..operators.labels import N_SPLITS, build_label, embargo, group_folds, sample_weight, split_summary
from ..operators.model import baseline_scores, label_sketches, merged_quantiles, model_metadata, rank_error
from ..session import scratch_path
from ..sources import store
from ..sources.bars import cut_after_last_close, drop_missing_close, read_tickers, table
from . import pipeline as P
from . import report

HORIZONS = P.HORIZONS
# Moving-average periods that the registered queries ask for.  Monthly ones take
# 10/20/50 instead of the default list: the driver's tables hold ~83 months, so
# averages over 100 and more would be NULL on every row.
# T4 asks for this many features: fewer than a horizon has, so that the limit bites.
TOP_FEATURES = 10
PERIODS = {"daily": MODEL_PERIODS, "weekly": MODEL_PERIODS, "monthly": (10, 20, 50)}
Q = Callable[[SparkSession, str], DataFrame]


def finish(df: DataFrame) -> DataFrame:
    """Double columns on the comparison grid (and -0.0 folded into 0.0).

    First to float32 (a relative grid, IEEE round-half-even in every engine),
    then to multiples of 2**-20 (an absolute grid): values that differ only in
    the last bits of a sum, large or near zero, land on the same number.
    """
    out = []
    for c, t in df.dtypes:
        if t in ("double", "float"):
            r = F.round(F.col(c).cast("float").cast("double") * GRID, 0)
            out.append(F.when(r == 0, F.lit(0.0)).otherwise(r / GRID).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ---------------------------------------------------------------- spark side
BLOCK_QUERIES = {"returns": "returns", "sma": "sma", "ema": "ema", "volume_block": "volume",
                 "range_block": "range", "bollinger": "bollinger", "rsi": "rsi", "vix_asof": "vix"}

FEATURE_BLOCKS = {
    "dist_features": lambda n: n.startswith("dist_"),
    "bb_features": lambda n: n.startswith(("bb_pctb_", "bb_width_")),
    "rel_volume": lambda n: n.startswith("rel_vol_"),
    "range_pct": lambda n: n.startswith("range_pct_"),
    "cyclical": lambda n: n.startswith(("dow_", "month_sin", "month_cos")),
    "days_to_close": lambda n: n.startswith("days_to_close_"),
}


def _feature_block(pred):
    def q(spark, sf):
        pooled = P.pooled(spark, sf, MODEL_PERIODS)
        cols = {}
        for h in HORIZONS:
            for n, c in engineered_columns(pooled, h, MODEL_PERIODS):
                if pred(n) and n not in cols:
                    cols[n] = c.cast("double")
        return finish(pooled.select("Date", "ticker", *[c.alias(n) for n, c in cols.items()]))
    return q


def q_realized_vol(spark, sf):
    """Rolling deviations of each horizon's returns, windows in blocks."""
    pooled = P.pooled(spark, sf, MODEL_PERIODS)
    rolling = [(f"realized_vol_{h}", "stddev_samp", HORIZON_SPEC[h]["rvol"][1], n, max(2, n // 2)) for h, n in REALIZED_VOL_WINDOW.items()]
    return finish(series_windows(pooled, ["ticker"], "Date", rolling, rows=BLOCK_ROWS).select("Date", "ticker", *[r[0] for r in rolling]))


#: Daily rows of a block where windows run in blocks; below the series' length, so that several take part.
BLOCK_ROWS = 512
IN_BLOCKS = ("sma", "volume")


def _block(b):
    rows = BLOCK_ROWS if b in IN_BLOCKS else None
    return lambda spark, sf: finish(P.raw(spark, sf, BACKEND_PERIODS, blocks=[b], block_rows=rows))


def q_long_series(spark, sf):
    """W1, W6, W8, W9, W14 over the events of each type, one long series each: in blocks and ranges, no task holds one."""
    events = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    out = series_windows(events, ["event_type"], "ts", tie=["event_id"], rows=1024,
                         rolling=[("mean_200", "avg", "value", 200, 200), ("std_50", "stddev_samp", "value", 50, 25), ("low_20", "min", "value", 20, 1)],
                         shifts=[("before", "value", 1), ("after", "value", -1)],
                         running=[("total", "sum", "value"), ("top", "max", "value"), ("n", "count", "value")])
    return finish(out.drop("ts", "value"))


def q_events_asof(spark, sf):
    """J2 with keys, a tolerance and intraday moments: each event, set back 24 years, with its user's last order of the 90 days before."""
    events = table(spark, sf, "events").select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 24 YEARS")).alias("at"))
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % 500).alias("user_id"), "o_orderdate", "o_orderkey", "o_totalprice")
    out = asof_join(events, orders, "at", ["user_id"], ["o_orderkey", "o_totalprice"], right_on="o_orderdate", tolerance="90 days", tie=["o_orderkey"])
    return finish(out.drop("at").withColumn("o_orderkey", F.col("o_orderkey").cast("string")))


def _names(spark, sf, h):
    """Feature names of a horizon's table."""
    return [c for c in P.features(spark, sf, h, PERIODS[h]).columns if c not in ("Date", "ticker", f"target_{h}")]


def _splits(spark, sf):
    return P.all_horizons(lambda h: P.split(spark, sf, h, PERIODS[h]).select("Date", "ticker", "group_id", "part"))


def _train(spark, sf, h):
    return P.split(spark, sf, h, PERIODS[h]).where(F.col("part") == "train")


def _scored(spark, sf):
    return P.all_horizons(lambda h: baseline_scores(P.split(spark, sf, h, PERIODS[h]), f"target_{h}")) \
        .select("horizon", "Date", "ticker", "y", "q10", "q50", "q90")


def _band(spark, sf):
    return decide.predict_band(_scored(spark, sf), ["horizon", "ticker", "Date"])


def _cards(spark, sf):
    b = _band(spark, sf)
    on_grid = finish(b)
    return decide.forecast_card(on_grid)


def _snapshot(spark, sf):
    """Daily rows that the store held at its last sync: tickers of flag A are up
    to date, the others stop where the gauge feed last updated."""
    cutoff = P.gauge(spark, sf).select(F.max("Date")).scalar()
    return P.daily(spark, sf).where(F.col("ticker").startswith("A") | (F.col("Date") <= cutoff))


def _store(spark, sf, name, daily, then=None):
    """A store filled once per session and input in the shared folder, and read back."""
    def build():
        root = scratch_path(spark, f"store-{name}-{uuid.uuid4().hex}")
        store.init_tables(spark, root, buckets=len(TICKERS))
        store.sync_store(spark, root, daily(spark, sf))
        if then:
            then(root)
        return root
    return store.open_store(spark, P.once(spark, ("store", name, sf, *P.inputs(spark, sf)), build))


def _union(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.withColumn("horizon", F.lit(h)) for h, t in tables.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def q_bars_daily(spark, sf):
    return finish(P.bars(spark, sf))


def q_horizon_split(spark, sf):
    pooled = P.pooled(spark, sf, MODEL_PERIODS)
    return finish(_union({h: select_horizon_columns(pooled, h) for h in HORIZONS}))


def q_trim_start(spark, sf):
    return finish(P.raw(spark, sf, BACKEND_PERIODS, blocks=["returns"], start_date="2000-01-01"))


def q_null_validation(spark, sf):
    v = snapshot_validation(P.raw(spark, sf, BACKEND_PERIODS))
    return v.select("ticker", "Date", F.array_join("null_features", ",").alias("null_features"),
                    F.col("n_nulls").cast("bigint").alias("n_nulls"), "is_valid")


def q_missing_report(spark, sf):
    return finish(P.all_horizons(lambda h: eda.missing_report(P.horizon_raw(spark, sf, h, PERIODS[h]))))


def q_pool_tickers(spark, sf):
    return finish(P.pooled(spark, sf, MODEL_PERIODS))


def q_features(h):
    return lambda spark, sf: finish(P.features(spark, sf, h, PERIODS[h]))


def q_label(h):
    def q(spark, sf):
        lab = build_label(P.horizon_raw(spark, sf, h, PERIODS[h]), h)
        return finish(lab.select("Date", "ticker", ANCHOR, f"target_{h}"))
    return q


def q_split_groups(spark, sf):
    return _splits(spark, sf)


def q_split_summary(spark, sf):
    return finish(P.all_horizons(lambda h: split_summary(P.split(spark, sf, h, PERIODS[h]), h)))


def q_kfold(spark, sf):
    return P.all_horizons(lambda h: group_folds(_train(spark, sf, h)).select("Date", "ticker", "group_id", "fold"))


def q_sample_weight(spark, sf):
    return finish(P.all_horizons(lambda h: sample_weight(_train(spark, sf, h)).select("Date", "ticker", "weight")))


def q_corr_matrix(spark, sf):
    return finish(P.all_horizons(lambda h: eda.corr_matrix(P.features(spark, sf, h, PERIODS[h]), _names(spark, sf, h))))


def q_corr_pairwise(spark, sf):
    """G12 on the raw columns of each horizon, null in the warm-up of their windows: pairs over the rows that have both."""
    def one(h):
        raw = P.horizon_raw(spark, sf, h, PERIODS[h])
        return eda.corr_matrix(raw, [c for c in raw.columns if c not in SHARED_COLUMNS])
    return finish(P.all_horizons(one))


def _associations(spark, sf, h):
    """Ranks need equal values to be equal in either engine: inputs are rounded to nine decimals."""
    df, target = P.features(spark, sf, h, PERIODS[h]), f"target_{h}"
    names = _names(spark, sf, h)
    return eda.association(df.select(*[F.round(F.col(c).cast("double"), 9).alias(c) for c in (*names, target)]), names, target)


def q_association(spark, sf):
    return finish(P.all_horizons(lambda h: _associations(spark, sf, h)))


def q_association_top(spark, sf):
    return finish(eda.top_association(P.all_horizons(lambda h: _associations(spark, sf, h)), TOP_FEATURES, by=["horizon"]))


def q_knn_information(spark, sf):
    """G15 by the k-nearest-neighbour estimator, every feature of every horizon."""
    def one(h):
        df = P.features(spark, sf, h, PERIODS[h])
        return knn_information(df, _names(spark, sf, h), f"target_{h}")
    return P.all_horizons(one)


def q_baseline_quantiles(spark, sf):
    return finish(_scored(spark, sf))


def _bucketed(spark, sf, h):
    """The split with the part of the candle that a row lies in."""
    return P.split(spark, sf, h, PERIODS[h]).withColumn("bucket", candle_part(F.col("Date"), h))


def q_baseline_buckets(spark, sf):
    """M10 per ticker and bucket: quantiles of the train rows in the same part of their candle, for the test rows."""
    return finish(P.all_horizons(lambda h: baseline_scores(_bucketed(spark, sf, h), f"target_{h}", ["ticker", "bucket"])))


def q_sketch_quantiles(spark, sf):
    """M10 from sketches per ticker, bucket and month, stored and merged over the train rows since 1998: rows, and whether
    the exact rank of each quantile in them is within the sketch's bound."""
    def one(h):
        by, target = ["ticker", "bucket"], F.col(f"target_{h}")
        rows = _bucketed(spark, sf, h).where(F.col("part") == "train")
        path = scratch_path(spark, f"sketches-{h}-{uuid.uuid4().hex}")
        label_sketches(rows, f"target_{h}", by, period_id(F.col("Date"), "monthly")).write.parquet(path)
        found = merged_quantiles(spark.read.parquet(path).where("period >= 199801"), by)
        window = rows.where("Date >= '1998-01-01'").join(found, by)
        share = lambda c: F.count_if(c) / F.count("*")
        slack = rank_error() + 1 / F.count("*")
        right = [(share(target < F.col(q)) - slack <= a) & (share(target <= F.col(q)) + slack >= a) for q, a in evaluate.QUANTILES.items()]
        return window.groupBy(*by).agg(F.first("n").alias("n"), functools.reduce(lambda a, b: a & b, right).alias("within_bound"))
    return P.all_horizons(one)


def q_evaluate_all(spark, sf):
    return finish(evaluate.evaluate_all(_scored(spark, sf)))


def q_confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_scored(spark, sf))


def q_recommendation(spark, sf):
    return finish(_band(spark, sf))


def q_contract_check(spark, sf):
    return decide.contract_check(_band(spark, sf))


def q_latest_dates(spark, sf):
    return store.latest_dates(_store(spark, sf, "whole", P.daily))


def q_sync_status(spark, sf):
    return store.sync_status(P.daily(spark, sf), _store(spark, sf, "snapshot", _snapshot))


def q_incremental_upsert(spark, sf):
    """The snapshot's store after one sync, all three tables."""
    return finish(_union(_store(spark, sf, "synced", _snapshot, lambda root: store.sync_store(spark, root, P.daily(spark, sf)))))


def q_retrain_flag(spark, sf):
    trained = P.all_horizons(lambda h: P.features(spark, sf, h, PERIODS[h]).agg(F.max("Date").alias("last_trained_through")))
    return store.retrain_flag(trained, P.daily(spark, sf), lambda h: period_id(F.col("Date"), h))


def q_market_snapshot(spark, sf):
    return finish(decide.market_snapshot(P.bars(spark, sf)))


def q_profit_estimate(spark, sf):
    return finish(decide.profit_estimate(_band(spark, sf), 1000.0, keep=["horizon", "ticker", "Date"]))


def q_forecast_card(spark, sf):
    return _cards(spark, sf)


def q_market_summary(spark, sf):
    return finish(decide.market_summary(_cards(spark, sf)))


def q_interval_sample(spark, sf):
    return finish(sampling.interval_sample(_scored(spark, sf)))


def q_residual_hist(spark, sf):
    return finish(sampling.residual_hist(_scored(spark, sf)))


def q_store_read(spark, sf):
    tables = _store(spark, sf, "whole", P.daily)
    return finish(_union({h: store.read_horizon(tables, h, start_date="2000-01-01") for h in HORIZONS}))


TICKERS = ("AF", "AO", "NF", "NO", "RF", "RO")  # the series that the line items give (FIXTURES.md)


def _folds(spark, sf, h):
    """The train rows with fold and weight, written once."""
    return P.stage(spark, ("folds", h, sf, *P.inputs(spark, sf)), lambda: sample_weight(group_folds(_train(spark, sf, h))))


def _curve(spark, sf, h):
    """M4, M6: out-of-fold losses of the horizon for every number of trees, written once."""
    build = lambda: learning_curve(_folds(spark, sf, h), _names(spark, sf, h), f"target_{h}", h, TICKERS, N_SPLITS)
    return P.stage(spark, ("curve", h, sf, *P.inputs(spark, sf)), build)


def _saved_forest(spark, sf, h, name, rows) -> QuantileForest:
    """The horizon's forest of this name, fitted on ``rows()`` with their own weights and as many trees as
    cross validation chose (M7), saved once and loaded."""
    def build():
        path = scratch_path(spark, f"{name}-{h}-{uuid.uuid4().hex}")
        trees = best_trees(_curve(spark, sf, h))
        fit_forest(sample_weight(rows()), _names(spark, sf, h), f"target_{h}", h, TICKERS, trees=trees).save(path)
        return path
    return QuantileForest.load(spark, P.once(spark, (name, h, sf, *P.inputs(spark, sf)), build))


def _forest(spark, sf, h) -> QuantileForest:
    """The forest of the train part, for forecasts of the test part."""
    return _saved_forest(spark, sf, h, "forest", lambda: _train(spark, sf, h))


def _final_forest(spark, sf, h) -> QuantileForest:
    """M8: the forest refitted on train and test (U2), for forecasts of new rows."""
    def rows():
        split = P.split(spark, sf, h, PERIODS[h])
        return union_tables([split.where(F.col("part") == part) for part in ("train", "test")])
    return _saved_forest(spark, sf, h, "final-forest", rows)


def q_cv_curve(spark, sf):
    """Folds, quantiles and every number of trees, with the fold's rows and whether a loss was found."""
    return P.all_horizons(lambda h: _curve(spark, sf, h)).select(
        "horizon", "fold", "quantile", "trees", "n_rows", (F.col("pinball") > 0).alias("has_loss"))


def q_cv_summary(spark, sf):
    """M5, M7: the loss of every number of trees and the one that the registered fits take."""
    return curve_summary(P.all_horizons(lambda h: _curve(spark, sf, h)), ["horizon"])


def _times(spark, sf, h):
    """The train rows with ``times``, their sample weights as whole frequencies (forest.WEIGHT_STEPS for the least)."""
    rows = _folds(spark, sf, h)
    least = rows.agg(F.min("weight")).scalar()
    return rows.withColumn("times", F.round(F.col("weight") / least * WEIGHT_STEPS).cast("long"))


def q_quantile_regression(spark, sf):
    """M3 on the pinball objective: for each line the rows below it are what its level asks, to within one row's
    weight, and its loss is no more than that of the best constant."""
    def one(h):
        rows, target = _times(spark, sf, h), F.col(f"target_{h}")
        model = fit_lines(rows, _names(spark, sf, h), f"target_{h}", TICKERS, "times")
        scored = model.predict(rows, [target.alias("y"), "times"])
        ends = scored.agg(F.percentile("y", F.array(*map(F.lit, evaluate.QUANTILES.values())), F.col("times"))).scalar()
        loss = lambda miss, a: F.sum(F.col("times") * F.greatest(a * miss, (a - 1) * miss))
        scored, out = scored.withColumn("ends", ends), []
        total, most = F.sum("times"), F.max("times")
        for i, (q, a) in enumerate(evaluate.QUANTILES.items()):
            gap = 1e-9 * F.greatest(F.lit(1.0), F.abs("y"))  # labels on the line, but for rounding
            below = F.sum(F.when(F.col("y") < F.col(q) - gap, F.col("times")).otherwise(0))
            up_to = F.sum(F.when(F.col("y") <= F.col(q) + gap, F.col("times")).otherwise(0))
            out.append(F.struct(F.lit(q).alias("quantile"), F.count("*").alias("n_rows"),
                                ((below <= a * total + most) & (up_to >= a * total - most)).alias("share_ok"),
                                (loss(F.col("y") - F.col(q), a) <= loss(F.col("y") - F.col("ends")[i], a) * (1 + 1e-9)).alias("loss_ok")))
        return scored.agg(F.array(*out).alias("l")).select(F.inline("l"))
    return P.all_horizons(one)


def _forecast(spark, sf, h):
    test = P.split(spark, sf, h, PERIODS[h]).where(F.col("part") == "test").withColumn("y", F.col(f"target_{h}"))
    return _forest(spark, sf, h).predict(test, ["Date", "ticker", "y"])


def q_model_contract(spark, sf):
    """M5-M9, K12, D5 on a saved and loaded model: the test part's forecasts
    per ticker, none missing or crossed, and per horizon a coverage and a
    pinball loss that a usable forecast has (against the baseline's)."""
    scored = P.all_horizons(lambda h: _forecast(spark, sf, h))
    band = decide.predict_band(scored, ["horizon", "ticker", "Date"])
    rows = band.groupBy("horizon", "ticker").agg(
        F.count("*").alias("n_predictions"),
        F.count_if(F.col("low").isNull() | F.col("mid").isNull() | F.col("high").isNull()).alias("n_missing"),
        F.count_if((F.col("low") > F.col("mid")) | (F.col("mid") > F.col("high"))).alias("n_crossed"),
        F.count_if(~F.col("confidence").between(0, 1)).alias("n_out_of_range"))
    own, base = evaluate.evaluate_all(scored), evaluate.evaluate_all(_scored(spark, sf))
    loss = lambda df: df.select("horizon", (F.col("pinball_q10") + F.col("pinball_q50") + F.col("pinball_q90")).alias("loss"))
    flags = own.select("horizon", F.col("coverage").between(0.6, 0.95).alias("coverage_ok")).join(
        loss(own), "horizon").join(loss(base).withColumnRenamed("loss", "base"), "horizon").select(
        "horizon", "coverage_ok", (F.col("loss") <= 1.1 * F.col("base")).alias("pinball_ok"))
    return rows.join(flags, "horizon")


def q_batch_predict(spark, sf):
    """The newest row of every ticker, and one of a ticker that the model
    never saw, aligned to the columns of the final model and forecast by it (M8)."""
    def one(h):
        model, raw_h = _final_forest(spark, sf, h), P.horizon_raw(spark, sf, h, PERIODS[h])
        rows = raw_h.withColumns({n: c.cast("double") for n, c in engineered_columns(raw_h, h, PERIODS[h])})
        newest = rows.join(rows.groupBy("ticker").agg(F.max("Date").alias("Date")), ["ticker", "Date"])
        newest = newest.unionByName(newest.where("ticker = 'AF'").withColumn("ticker", F.lit("ZZ")))
        return model.predict(align_to(newest, model.features, ["Date", "ticker"]), ["Date", "ticker"])
    band = decide.predict_band(P.all_horizons(one), ["horizon", "ticker", "Date"])
    return band.select("horizon", "ticker", "Date", ((F.col("low") <= F.col("mid")) & (F.col("mid") <= F.col("high"))).alias("in_order"),
                       F.col("confidence").between(0, 1).alias("in_range"))


def q_model_evaluate(spark, sf):
    """K9 and T6 on the model's output: class counts sum to the test rows, and
    the interval sample's size and ends."""
    scored = P.all_horizons(lambda h: _forecast(spark, sf, h))
    matrix = evaluate.confusion_matrix(scored).groupBy("horizon").agg(F.sum("n").cast("long").alias("n_classified"), F.count("*").alias("n_cells"))
    sample = sampling.interval_sample(scored).groupBy("horizon").agg(
        F.count("*").alias("n_sampled"), F.min("y").alias("least_move"), F.max("y").alias("largest_move"))
    return finish(matrix.join(sample, "horizon"))


def q_removed_counts(spark, sf):
    """B5, B6, G7 on bars with gaps: AF has no close after June 2001, no ticker one on the 13th."""
    gap = ((F.col("ticker") == "AF") & (F.col("Date") > F.to_date(F.lit("2001-06-30")))) | (F.dayofmonth("Date") == 13)
    bars = P.bars(spark, sf).withColumn("Close", F.when(~gap, F.col("Close")))
    cut = cut_after_last_close(bars)
    return removed_counts(bars, cut, "after last close").unionByName(removed_counts(cut, drop_missing_close(cut), "missing close"))


def q_unknown_tickers(spark, sf):
    """Names as a feed writes them (^A.F), normalised; what the store does not know under that name."""
    own = P.bars(spark, sf).select("ticker").distinct()
    fed = own.select(store.normalize_ticker(F.concat(F.lit("^"), F.substring("ticker", 1, 1), F.lit("."), F.substring("ticker", 2, 1))).alias("ticker"))
    return store.unknown_tickers(fed.unionByName(own), P.bars(spark, sf))


def q_history_filter(spark, sf):
    return finish(history_filter(P.bars(spark, sf), "monthly", "1998-01-01"))


def q_non_finite(spark, sf):
    """Infinite on the 13th and no number on the 14th, made missing in every numeric column."""
    day = F.dayofmonth("Date")
    bars = P.bars(spark, sf).withColumn("Close", F.when(day == 13, float("inf")).when(day == 14, float("nan")).otherwise(F.col("Close")))
    return finish(non_finite_to_null(bars, numeric_columns(bars)))


def q_embargo(spark, sf):
    """I7 with one candle: training candles of the other folds that do not touch a candle of fold 0."""
    def one(h):
        folds = group_folds(_train(spark, sf, h))
        return embargo(folds.where("fold <> 0"), folds.where("fold = 0"), 1).select("Date", "ticker", "group_id")
    return P.all_horizons(one)


def q_stage_handoff(spark, sf):
    """The split written as a partitioned stage, its parts read by themselves and stacked."""
    def one(h):
        path = scratch_path(spark, f"handoff-{h}-{uuid.uuid4().hex}")
        store.write_stage(P.split(spark, sf, h, PERIODS[h]).select("Date", "ticker", "group_id", "part"), path, ["part"])
        return union_tables([store.read_stage(spark, path, part=p) for p in ("train", "test")])
    return P.all_horizons(one)


def _ticker_files(spark, sf):
    """The bars written as one file folder a ticker; that of AF without its ticker column, that of NF without its volume."""
    def build():
        folder = scratch_path(spark, f"tickers-{uuid.uuid4().hex}")
        for t in TICKERS:
            own = P.bars(spark, sf).where(F.col("ticker") == t).drop(*{"AF": ["ticker"], "NF": ["Volume"]}.get(t, []))
            own.write.parquet(f"{folder}/{t}.parquet")
        return folder
    return P.once(spark, ("ticker-files", sf, *P.inputs(spark, sf)), build)


def q_ticker_files(spark, sf):
    """A2: all tickers' files by one scan."""
    return finish(read_tickers(spark, _ticker_files(spark, sf), TICKERS))


def q_missing_anchor(spark, sf):
    """B7 on anchors with gaps: none on the 13th of a month."""
    pooled = P.pooled(spark, sf, MODEL_PERIODS).select("Date", "ticker", ANCHOR)
    return finish(drop_missing_anchor(pooled.withColumn(ANCHOR, F.when(F.dayofmonth("Date") != 13, F.col(ANCHOR)))))


def _reports(spark, sf, name, scored):
    """The report files of a run, written once."""
    build = lambda: report.test_stage(scored(spark, sf), scratch_path(spark, f"test-{name}-{uuid.uuid4().hex}"))
    return P.once(spark, ("reports", name, sf, *P.inputs(spark, sf)), build)


def q_report_metrics(spark, sf):
    """A14, K12, S-json: the baseline's metrics record, read back from its JSON lines."""
    schema = evaluate.evaluate_all(_scored(spark, sf)).schema
    return finish(report.read_records(spark, _reports(spark, sf, "baseline", _scored)["metrics"], schema))


def q_report_residuals(spark, sf):
    """The baseline's residual histogram, read back from CSV."""
    schema = sampling.residual_hist(_scored(spark, sf)).schema
    return finish(spark.read.schema(schema).option("header", "true").csv(_reports(spark, sf, "baseline", _scored)["residuals"]))


def q_model_report(spark, sf):
    """K11, K12 on the saved model's forecasts of the test part: every metric, from the record that the run wrote."""
    scored = lambda spark, sf: P.all_horizons(lambda h: _forecast(spark, sf, h))
    schema = evaluate.evaluate_all(_scored(spark, sf)).schema
    return report.read_records(spark, _reports(spark, sf, "model", scored)["metrics"], schema)


def q_report_sink(spark, sf):
    """The split summary written as CSV and read back."""
    path = scratch_path(spark, f"report-{uuid.uuid4().hex}")
    report = P.all_horizons(lambda h: split_summary(P.split(spark, sf, h, PERIODS[h]), h))
    store.write_report(report, path)
    return finish(spark.read.schema(report.schema).option("header", "true").csv(path))


def q_model_metadata(spark, sf):
    """A15, G11."""
    one = lambda h: model_metadata(_train(spark, sf, h), h, _names(spark, sf, h), TICKERS)
    return P.all_horizons(one).select("horizon", "n_rows", "last_trained_through", F.size("feature_columns").alias("n_features"))


def q_snapshot_records(spark, sf):
    """One struct per horizon and record; a field of each."""
    tables = _store(spark, sf, "whole", P.daily)
    records = {h: store.as_records(t).withColumnRenamed("features", h) for h, t in tables.items()}
    joined = records["daily"].join(records["weekly"], list(store.KEYS)).join(records["monthly"], list(store.KEYS))
    return finish(joined.select("ticker", "Date", "daily.close_daily_last", "weekly.close_weekly_last", "monthly.close_monthly_last"))


def _listed_once(query: Q) -> Q:
    @functools.wraps(query)
    def run(spark, sf):
        with P.one_listing():
            return query(spark, sf)
    return run


def registry() -> dict[str, Q]:
    reg: dict[str, Q] = {"bars_daily": q_bars_daily}
    for name, b in BLOCK_QUERIES.items():
        reg[name] = _block(b)
    reg.update({
        "horizon_split": q_horizon_split, "trim_start": q_trim_start,
        "null_validation": q_null_validation, "missing_report": q_missing_report,
        "pool_tickers": q_pool_tickers,
    })
    for name, pred in FEATURE_BLOCKS.items():
        reg[name] = _feature_block(pred)
    for h in HORIZONS:
        reg[f"features_{h}"] = q_features(h)
    for h in HORIZONS:
        reg[f"label_{h}"] = q_label(h)
    reg.update({
        "split_groups": q_split_groups, "split_summary": q_split_summary, "kfold": q_kfold,
        "sample_weight": q_sample_weight, "corr_matrix": q_corr_matrix, "corr_pairwise": q_corr_pairwise, "association": q_association,
        "association_top": q_association_top, "knn_information": q_knn_information, "baseline_quantiles": q_baseline_quantiles,
        "baseline_buckets": q_baseline_buckets, "sketch_quantiles": q_sketch_quantiles,
        "evaluate_all": q_evaluate_all, "confusion_matrix": q_confusion_matrix,
        "recommendation": q_recommendation, "contract_check": q_contract_check,
        "latest_dates": q_latest_dates, "sync_status": q_sync_status,
        "incremental_upsert": q_incremental_upsert, "retrain_flag": q_retrain_flag,
        "market_snapshot": q_market_snapshot, "profit_estimate": q_profit_estimate,
        "forecast_card": q_forecast_card, "market_summary": q_market_summary,
        "interval_sample": q_interval_sample, "residual_hist": q_residual_hist,
        "store_read": q_store_read, "removed_counts": q_removed_counts,
        "unknown_tickers": q_unknown_tickers, "history_filter": q_history_filter,
        "non_finite": q_non_finite, "embargo": q_embargo, "stage_handoff": q_stage_handoff, "report_sink": q_report_sink,
        "model_metadata": q_model_metadata, "snapshot_records": q_snapshot_records,
        "realized_vol": q_realized_vol, "long_series": q_long_series, "events_asof": q_events_asof,
        "cv_curve": q_cv_curve, "cv_summary": q_cv_summary, "ticker_files": q_ticker_files, "missing_anchor": q_missing_anchor,
        "report_metrics": q_report_metrics, "report_residuals": q_report_residuals, "model_report": q_model_report, "quantile_regression": q_quantile_regression,
        "model_contract": q_model_contract, "batch_predict": q_batch_predict, "model_evaluate": q_model_evaluate,
    })
    return {name: _listed_once(query) for name, query in reg.items()}
