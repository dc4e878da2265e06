"""Quantile forecasters.

M10 is the SQL-checkable baseline: the empirical 10/50/90 % quantiles of the
label per ticker on the train part, applied to the test part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from .evaluate import QUANTILES
from .sampling import ordered_position


def baseline_quantiles(train: DataFrame, target: str, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Exact (linearly interpolated) quantiles of the label per group, from its
    rows' positions in order: no task holds a whole group.  One row per group."""
    placed = ordered_position(train.where(F.col(target).isNotNull()).select(*by, target), by, target, [])
    found = []
    for q, a in QUANTILES.items():
        at = F.lit(a) * (F.col("_n") - 1)
        low = F.max(F.when(F.col("position") == F.floor(at), F.col(target)))
        high = F.max(F.when(F.col("position") == F.ceil(at), F.col(target)))
        found.append((low + (high - low) * F.max(at - F.floor(at))).alias(q))
    return placed.groupBy(*by).agg(*found)


def baseline_scores(split: DataFrame, target: str, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Test rows with ``y`` and the train-fitted baseline quantiles."""
    q = baseline_quantiles(split.where(F.col("part") == "train"), target, by)
    test = split.where(F.col("part") == "test")
    return test.join(q, list(by), "left").select("Date", *by, F.col(target).alias("y"), *QUANTILES.keys())


#: Size of a quantile sketch, and the rank error that it keeps to however many sketches are merged.
SKETCH_K = 400


def rank_error(k: int = SKETCH_K) -> float:
    """The published bound of a KLL sketch's error in rank, as a share of the rows."""
    return 2.296 / k ** 0.9723


def label_sketches(rows: DataFrame, target: str, by: Sequence[str], period: Column, k: int = SKETCH_K) -> DataFrame:
    """M10 from stored parts: (by, period, n, sketch), a quantile sketch of the labels of each group and period.

    A sketch has a bounded size; a new period adds rows and changes no old one.
    """
    return rows.where(F.col(target).isNotNull()).groupBy(*by, period.alias("period")).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(target).cast("double"), F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """(by, n, q10, q50, q90) of the merged sketches: any periods, no label read again; ranks are right to ``rank_error``."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("_all"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("_all", F.lit(a)).alias(q) for q, a in QUANTILES.items()])


# ---------------------------------------------------------------- frame and metadata of the fitted model
# Per-horizon depth limit, minimum rows per leaf, row and column
# subsampling, and seed.  Boosting rounds, learning rate, early stopping,
# leaf-count and L1/L2 penalties have no counterpart in a forest; its number of
# trees is chosen by cross validation.
HORIZON_PARAMS = {
    "daily": {"max_depth": 5, "min_leaf": 40, "subsample": 0.8, "colsample": 0.8},
    "weekly": {"max_depth": 6, "min_leaf": 60, "subsample": 0.8, "colsample": 0.8},
    "monthly": {"max_depth": 4, "min_leaf": 80, "subsample": 0.7, "colsample": 0.7},
}
SEED = 42


def model_frame(df: DataFrame, features: Sequence[str], tickers: Sequence[str]) -> DataFrame:
    """M1: feature vector with the ticker as a fixed-domain category (unknown
    tickers get the extra index, B20)."""
    feats = [c for c in features if c != "ticker"]
    idx = StringIndexerModel.from_labels(list(tickers), inputCol="ticker", outputCol="_ticker_idx",
                                         handleInvalid="keep")
    out = idx.transform(df)
    return VectorAssembler(inputCols=feats + ["_ticker_idx"], outputCol="_features",
                           handleInvalid="keep").transform(out)


def model_metadata(full: DataFrame, horizon: str, features: Sequence[str], tickers: Sequence[str]) -> DataFrame:
    """One-row metadata (feature order, tickers, rows, last trained date)."""
    return full.agg(F.count("*").cast("bigint").alias("n_rows"), F.max("Date").alias("last_trained_through")) \
        .select(F.lit(horizon).alias("horizon"), F.array(*[F.lit(c) for c in features]).alias("feature_columns"),
                F.array(*[F.lit(t) for t in tickers]).alias("tickers"), "n_rows", "last_trained_through")
