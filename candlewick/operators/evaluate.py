"""Interval-forecast metrics (K1-K12) as aggregate expressions over
``(y, q10, q50, q90)``; one ``groupBy(...).agg`` pass computes all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quantile levels, nominal band coverage and class labels.
QUANTILES = {"q10": 0.10, "q50": 0.50, "q90": 0.90}
NOMINAL_COVERAGE = 0.80
PRED_CLASSES = ("Short", "Stay-out", "Long")
ACTUAL_CLASSES = ("Below band", "Within band", "Above band")


def predicted_recommendation(q_low: Column, q_high: Column) -> Column:
    """K7: 0 Short (band fully negative), 2 Long (fully positive), else 1; Short wins."""
    return F.when(q_high < 0, F.lit(0)).when(q_low > 0, F.lit(2)).otherwise(F.lit(1))


def actual_band_class(y: Column, q_low: Column, q_high: Column) -> Column:
    """K8: 0 below the band, 2 above it, else 1; above wins."""
    return F.when(y > q_high, F.lit(2)).when(y < q_low, F.lit(0)).otherwise(F.lit(1))


def pinball(y: Column, q: Column, alpha: float) -> Column:
    e = y - q
    return F.avg(F.when(e >= 0, alpha * e).otherwise((alpha - 1.0) * e))


def metric_columns(y="y", q10="q10", q50="q50", q90="q90",
                   nominal: float = NOMINAL_COVERAGE, alphas: dict | None = None) -> list[Column]:
    """K1-K6, K10, K11 as aggregate columns (flat record)."""
    alphas = alphas or QUANTILES
    y, lo, mid, hi = F.col(y), F.col(q10), F.col(q50), F.col(q90)
    a = 1.0 - nominal
    width = hi - lo
    below = F.when(y < lo, (2.0 / a) * (lo - y)).otherwise(F.lit(0.0))
    above = F.when(y > hi, (2.0 / a) * (y - hi)).otherwise(F.lit(0.0))
    err = y - mid
    hit = predicted_recommendation(lo, hi) == actual_band_class(y, lo, hi)
    return [
        F.count("*").cast("bigint").alias("n_samples"),
        F.avg(((y >= lo) & (y <= hi)).cast("double")).alias("coverage"),
        F.lit(float(nominal)).alias("nominal_coverage"),
        F.avg(width).alias("mean_band_width"),
        F.avg(width + below + above).alias("interval_score"),
        pinball(y, lo, alphas["q10"]).alias("pinball_q10"),
        pinball(y, mid, alphas["q50"]).alias("pinball_q50"),
        pinball(y, hi, alphas["q90"]).alias("pinball_q90"),
        F.avg(F.abs(err)).alias("q50_mae"),
        F.sqrt(F.avg(err * err)).alias("q50_rmse"),
        F.avg((F.signum(y) == F.signum(mid)).cast("double")).alias("directional_accuracy"),
        F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("confusion_accuracy"),
    ]


def evaluate_all(scored: DataFrame, by: Sequence[str] = ("horizon",), **kw) -> DataFrame:
    """One metric row per group."""
    return scored.groupBy(*by).agg(*metric_columns(**kw))


def confusion_matrix(scored: DataFrame, by: Sequence[str] = ("horizon",),
                     y="y", q10="q10", q90="q90") -> DataFrame:
    """K9: 3x3 counts per group, zero cells kept.

    The 9 cells of every group come from exploding a literal array next to the
    distinct group keys (a generator, no join on the data), then the counted
    cells are left-joined on (group, pred, actual).
    """
    pred = predicted_recommendation(F.col(q10), F.col(q90))
    act = actual_band_class(F.col(y), F.col(q10), F.col(q90))
    counts = (scored.select(*by, pred.alias("pred"), act.alias("actual"))
              .groupBy(*by, "pred", "actual").agg(F.count("*").cast("bigint").alias("n")))
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("pred"), F.lit(a).alias("actual"))
                               for p in range(3) for a in range(3)]))
    spine = scored.select(*by).distinct().select(*by, cells.alias("c")).select(*by, "c.pred", "c.actual")
    labels_p = F.element_at(F.array(*[F.lit(x) for x in PRED_CLASSES]), F.col("pred") + 1)
    labels_a = F.element_at(F.array(*[F.lit(x) for x in ACTUAL_CLASSES]), F.col("actual") + 1)
    return (spine.join(counts, [*by, "pred", "actual"], "left")
            .select(*by, "pred", "actual", labels_p.alias("pred_label"), labels_a.alias("actual_label"),
                    F.coalesce(F.col("n"), F.lit(0).cast("bigint")).alias("n")))
