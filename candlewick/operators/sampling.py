"""Chart data behind the test-stage figures (T6, T7): evenly spaced sample of
scored rows ordered by the realized move, and the Q50 residual histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_INTERVAL_POINTS = 300
RESIDUAL_BINS = 40


def _idiv(a, b):
    """Floor division of non-negative integers (exact below 2**52)."""
    return F.floor(a / b).cast("bigint")


def in_buckets(df: DataFrame, by: Sequence[str], y: str, buckets: int = 64) -> DataFrame:
    """Add ``_b`` (ordered range of y within the group), ``_off`` (rows of the
    group in lower ranges) and ``_n`` (rows of the group).

    Approximate quantile edges cut each group; a value equal to an edge goes
    to the lower range, so equal values share one.
    """
    fr = [i / buckets for i in range(1, buckets)]
    edges = df.groupBy(*by).agg(F.percentile_approx(F.col(y), fr, 10000).alias("_edges"))
    b = df.join(edges, list(by)).withColumn(
        "_b", F.size(F.filter("_edges", lambda e: e < F.col(y)))).drop("_edges")
    sizes = b.groupBy(*by, "_b").agg(F.count("*").alias("_cnt"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(*by, "_b", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                        F.sum("_cnt").over(Window.partitionBy(*by)).alias("_n"))
    return b.join(offs, [*by, "_b"])


def ordered_position(df: DataFrame, by: Sequence[str], y: str, tie: Sequence[str],
                     buckets: int = 64) -> DataFrame:
    """0-based position of every row in (y, *tie) order within its group,
    computed without putting a whole group in one task.

    Range sizes give each range's offset, and rows are ranked inside their
    range.  The edges only balance the work: positions are exact.
    """
    b = in_buckets(df, by, y, buckets)
    inside = Window.partitionBy(*by, "_b").orderBy(F.col(y), *[F.col(c) for c in tie])
    return (b
            .withColumn("position", (F.row_number().over(inside) - 1 + F.col("_off")).cast("int"))
            .drop("_b", "_off"))


def interval_sample(scored: DataFrame, by: Sequence[str] = ("horizon",), y: str = "y",
                    tie: Sequence[str] = ("ticker", "Date"), max_points: int = MAX_INTERVAL_POINTS) -> DataFrame:
    """Rows at positions floor(i*(n-1)/(m-1)), i = 0..m-1, of each group
    ordered by y (all rows when n <= m), with their 0-based position.

    Membership of position r is decided in closed form, so no index list is
    built: the smallest i reaching r is ceil(r*(m-1)/(n-1)).
    """
    m = max_points
    df = ordered_position(scored, by, y, tie)
    r, n = F.col("position"), F.col("_n")
    i0 = _idiv(r * (m - 1) + (n - 2), n - 1)
    keep = (n <= m) | (_idiv(i0 * (n - 1), F.lit(m - 1)) == r)
    return df.where(keep).drop("_n")


def residual_hist(scored: DataFrame, by: Sequence[str] = ("horizon",), y: str = "y", q: str = "q50",
                  bins: int = RESIDUAL_BINS) -> DataFrame:
    """Counts of y - q in ``bins`` equal-width bins between the group's min
    and max (last bin closed); every bin is returned, empty ones with 0."""
    res = scored.select(*by, (F.col(y) - F.col(q)).alias("r"))
    rng = res.groupBy(*by).agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    lo = F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5)
    hi = F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5)
    rng = rng.select(*by, lo.alias("lo"), hi.alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    counts = res.join(rng, list(by)).groupBy(*by, b.alias("bin")).agg(F.count("*").cast("bigint").alias("n"))
    spine = rng.select(*by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return (spine.join(counts, [*by, "bin"], "left")
            .select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_low"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_high"),
                    F.coalesce(F.col("n"), F.lit(0).cast("bigint")).alias("n")))
