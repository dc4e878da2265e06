"""Data-quality and association reports.

All statistics are single-pass aggregates or per-feature windows over a long
(feature, value) table, ranked range by range; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .labels import pct_2dp

MI_BINS = 10          # equal-frequency bins per variable for mutual information
TOP_N_ASSOCIATION = 25
RANK_RANGES = 64      # ranges of values in which ranks are taken


def missing_report(df: DataFrame) -> DataFrame:
    """G6 + T3: null count and percent per column, only columns with nulls, worst first."""
    cols = df.columns
    counts = df.agg(F.count("*").alias("__n"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = counts.unpivot(["__n"], cols, "column", "missing")
    return (long.where(F.col("missing") > 0)
            .select("column", F.col("missing").cast("bigint").alias("missing"),
                    pct_2dp(F.col("missing"), F.col("__n")).alias("missing_pct"))
            .orderBy(F.col("missing").desc(), "column"))


def _pair_corr(a: Column, b: Column) -> Column:
    """Pearson on pairwise-complete rows; NULL for < 2 rows or zero variance."""
    a2 = F.when(b.isNotNull(), a)
    b2 = F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_samp(a2, b2), F.stddev_samp(a2) * F.stddev_samp(b2))


def _co_moments(means: list[float]):
    """Arrow function: rows to one row per column and task with its co-moments with every column, under both null masks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(means)
        n, x, xx, xy = (np.zeros((d, d)) for _ in range(4))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]
            values = np.stack(columns, 1) - np.array(means) if batch.num_rows else np.empty((0, d))
            known = np.isfinite(values)
            values = np.where(known, values, 0.0)
            mask = known.astype(np.float64)
            n += mask.T @ mask
            x += values.T @ mask          # sum of column i where j is known too
            xx += (values * values).T @ mask
            xy += values.T @ values
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), *[pa.array(m.tolist(), pa.list_(pa.float64())) for m in (n, x, xx, xy)]],
                                         ["i", "n", "x", "xx", "xy"])
    return run


def corr_matrix(df: DataFrame, features: Sequence[str], least: int = 2) -> DataFrame:
    """Long (feature_1, feature_2, corr), full symmetric matrix, each pair
    over the rows in which both are known (neither null nor non-finite).

    Columns are centred by their means first, so the sums stay small. A task
    adds up its rows into four matrices (rows, sums, squares and products under
    both masks); these add up column by column over the tasks, and nothing but
    the means comes to the driver. Pairs with fewer than ``least`` common rows
    or without variance there have a NULL.
    """
    feats = list(features)
    known = df.select(*[F.when(F.abs(c) < float("inf"), c).alias(f"x{i}") for i, c in enumerate(F.col(f).cast("double") for f in feats)])
    means = known.agg(*[F.avg(c).alias(c) for c in known.columns]).first()  # one number a column
    parts = known.mapInArrow(_co_moments([m or 0.0 for m in means]), "i int, n array<double>, x array<double>, xx array<double>, xy array<double>")
    cells = parts.select("i", F.posexplode(F.arrays_zip("n", "x", "xx", "xy")).alias("j", "m"))
    sums = cells.groupBy("i", "j").agg(*[F.sum(f"m.{c}").alias(c) for c in ("n", "x", "xx", "xy")])
    turned = sums.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("x").alias("y"), F.col("xx").alias("yy"))
    both = sums.join(turned, ["i", "j"])
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    corr = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.sqrt(spread("x", "xx")) * F.sqrt(spread("y", "yy")))
    enough = (F.col("n") >= least) & (spread("x", "xx") > 1e-12 * F.col("xx")) & (spread("y", "yy") > 1e-12 * F.col("yy"))
    name = F.array(*[F.lit(f) for f in feats])
    return both.select(F.get(name, F.col("i")).alias("feature_1"), F.get(name, F.col("j")).alias("feature_2"),
                       F.when(enough, F.when(F.col("i") == F.col("j"), 1.0).otherwise(corr)).alias("corr"))


def clean_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows finite and non-null in every listed column (B13), as one filter
    on the original columns (no re-aliasing, which keeps Catalyst's
    constraint inference linear in the number of columns)."""
    cond = " AND ".join(f"(`{c}` IS NOT NULL AND NOT isnan(`{c}`) AND abs(`{c}`) != double('inf'))" for c in cols)
    return df.select(*[F.col(c) for c in cols]).where(F.expr(cond))


def association(df: DataFrame, features: Sequence[str], target: str, bins: int = MI_BINS) -> DataFrame:
    """Pearson, Spearman and binned mutual information of each feature
    with the label, on rows complete in all features and the label.

    Mutual information uses ``bins`` equal-frequency bins per variable (bin of
    a value from its min rank) and natural logs; it replaces the reference's
    k-NN estimator and is meant for ranking features.  Ranks are taken in ranges
    of the values, so no task holds a whole feature: the wide rows are shuffled
    once for the label's ranks and the unfolded ones once for the features';
    what is joined to them is one row per range.
    """
    feats = list(features)
    clean = written(clean_rows(df, feats + [target]).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate([*feats, target])]), "clean")
    n = clean.count()
    columns = clean.columns
    # One pass gives the edges of all columns; they travel as one row, and each value finds its range before the rows are unfolded.
    levels = ", ".join(f"{i / RANK_RANGES}D" for i in range(1, RANK_RANGES))
    edges = clean.selectExpr(f"array({', '.join(f'percentile_approx({c}, array({levels}), 10000)' for c in columns)}) AS e").scalar()
    ranged = clean.withColumn("_edges", edges).selectExpr(*columns, *[f"size(filter(_edges[{i}], e -> e < {c})) AS r{i}" for i, c in enumerate(columns)])
    unfold = lambda upto: ", ".join(f"struct({i} AS feature, x{i} AS value, r{i} AS _b)" for i in range(upto))
    sizes = ranged.selectExpr(f"inline(array({unfold(len(columns))}))").groupBy("feature", "_b").agg(F.count("*").alias("_cnt"))
    before = Window.partitionBy("feature").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sizes.select("feature", "_b", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off")), "offsets")  # a row a range

    def ranks(rows: DataFrame, by: list[str], value: str, average: str, least: str) -> DataFrame:
        """Tie-averaged and least 1-based ranks, inside the ranges and on top of the lower ones."""
        first = F.rank().over(Window.partitionBy(*by, "_b").orderBy(value))
        ties = F.count("*").over(Window.partitionBy(*by, "_b", value))
        placed = rows.withColumns({"_in": first, "_ties": ties}).join(offsets, ["feature", "_b"])
        return placed.withColumns({least: F.col("_in") + F.col("_off"), average: F.col("_in") + F.col("_off") + (F.col("_ties") - 1) / 2.0}).drop(
            "_in", "_ties", "_off", "_b")

    last = len(feats)
    labelled = ranks(ranged.withColumns({"feature": F.lit(last), "_b": F.col(f"r{last}"), "_t": F.col(f"x{last}")}), [], "_t", "_t_rank", "_t_min").drop("feature")
    long = labelled.selectExpr("_t", "_t_rank", "_t_min", f"inline(array({unfold(last)}))")
    binned = lambda r: F.least(F.lit(bins - 1), F.floor((r - 1) * bins / n)).cast("int")
    j = written(ranks(long, ["feature"], "value", "_avg_rank", "_min_rank").select(
        F.get(F.array(*[F.lit(f) for f in feats]), F.col("feature")).alias("feature"), "value", "_t", "_avg_rank", "_t_rank",
        binned(F.col("_min_rank")).alias("bx"), binned(F.col("_t_min")).alias("by")), "ranked")
    stats = j.groupBy("feature").agg(
        _pair_corr(F.col("value"), F.col("_t")).alias("pearson"),
        _pair_corr(F.col("_avg_rank"), F.col("_t_rank")).alias("spearman"))
    joint = j.groupBy("feature", "bx", "by").agg(F.count("*").alias("nxy"))
    px = Window.partitionBy("feature", "bx")
    py = Window.partitionBy("feature", "by")
    mi = (joint.select("feature", "nxy", F.sum("nxy").over(px).alias("nx"), F.sum("nxy").over(py).alias("ny"))
          .groupBy("feature")
          .agg(F.sum((F.col("nxy") / n) * F.log(F.col("nxy") * n / (F.col("nx") * F.col("ny")))).alias("mutual_info")))
    return stats.join(mi, "feature").select("feature", "pearson", "spearman", "mutual_info").orderBy(F.desc("mutual_info"), "feature")


def top_association(report: DataFrame, n: int = TOP_N_ASSOCIATION, by: Sequence[str] = ()) -> DataFrame:
    """T4: top n features by mutual information (ties by name)."""
    if not by:
        return report.orderBy(F.col("mutual_info").desc(), "feature").limit(n)
    w = Window.partitionBy(*by).orderBy(F.col("mutual_info").desc(), "feature")
    return report.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")
