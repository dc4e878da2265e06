"""Mutual information by nearest neighbours (Kraskov, Stoegbauer and Grassberger's first estimator).

For every point (x, y) of a feature and the label: the distance to its k-th
neighbour, larger of both axes, and how many points lie nearer than that along
each axis alone. The plane is cut into tiles of about TILE points by quantiles
of both axes. A point is asked of its tile and those around it; if the k-th
distance reaches over their edge, it is asked again of twice as wide a square.
Counts along an axis are running counts inside its ranges plus those of the
ranges before. No task holds a feature.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .eda import clean_rows

NEIGHBOURS, TILE = 3, 512
_CHUNK = 2_000_000  # distances at a time


def digamma(m: Column) -> Column:
    """psi of a positive number: the asymptotic series ten steps up, brought back by its recurrence."""
    z = m + 10
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z ** 2) + 1 / (120 * z ** 4) - 1 / (252 * z ** 6)
    for i in range(10):
        series = series - 1 / (m + i)
    return series


def _long(names: list[str], means: dict, edges: dict[str, np.ndarray]):
    """Arrow function: rows of scaled columns to (row, feature, x, y, gx, gy)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n = batch.column("_row"), batch.num_rows
            y = (batch.column("_y").to_numpy() - means["_y"][0]) / means["_y"][1]
            gy = np.searchsorted(edges["_y"], y).astype(np.int32)
            for i, c in enumerate(names):
                x = (batch.column(c).to_numpy() - means[c][0]) / means[c][1]
                yield pa.RecordBatch.from_arrays(
                    [row, pa.array(np.full(n, i, np.int32)), pa.array(x), pa.array(y), pa.array(np.searchsorted(edges[c], x).astype(np.int32)), pa.array(gy)],
                    ["row", "feature", "x", "y", "gx", "gy"])
    return run


_ASKED = pa.schema([("feature", pa.int32()), ("row", pa.int64()), ("near", pa.list_(pa.float64()))])


def _nearest(k: int):
    """Of one tile: for every asked point the distances of its k nearest points there, itself left out."""
    def run(points: pa.Table, asked: pa.Table) -> pa.Table:
        if not points.num_rows or not asked.num_rows:
            return _ASKED.empty_table()
        own, px, py = (points.column(c).to_numpy() for c in ("row", "x", "y"))
        row, x, y = (asked.column(c).to_numpy() for c in ("row", "x", "y"))
        out, step = [], max(1, _CHUNK // len(own))
        for at in range(0, len(row), step):
            part = slice(at, at + step)
            far = np.maximum(np.abs(px[None, :] - x[part, None]), np.abs(py[None, :] - y[part, None]))
            far[own[None, :] == row[part, None]] = np.inf
            if far.shape[1] > k:
                far = np.partition(far, k - 1, axis=1)[:, :k]
            out += far.tolist()
        feature = points.column("feature")[0].as_py()
        return pa.Table.from_arrays([pa.array([feature] * len(row), pa.int32()), pa.array(row), pa.array(out, pa.list_(pa.float64()))], schema=_ASKED)
    return run


def _kth_distances(points: DataFrame, k: int, grid: int, names: list[str], edges: dict[str, np.ndarray]) -> DataFrame:
    """(feature, row, far): the distance of each point's k-th neighbour."""
    spark = points.sparkSession
    bounds = [(i, g, float(e[g - 1]) if g else None, float(e[g]) if g < grid - 1 else None)
              for i, c in enumerate([*names, "_y"]) for e in [edges[c]] for g in range(grid)]
    table = spark.createDataFrame(bounds, "axis int, g int, low double, high double")  # (features + 1) * grid rows
    open_, reach, found = points, 1, []
    while True:
        around = lambda g: F.sequence(F.greatest(F.lit(0), F.col(g) - reach), F.least(F.lit(grid - 1), F.col(g) + reach))
        asked = open_.select("feature", "row", "x", "y", F.explode(around("gx")).alias("gx"), "gy").select(
            "feature", "row", "x", "y", "gx", F.explode(around("gy")).alias("gy"))
        tile = ["feature", "gx", "gy"]
        near = points.groupBy(*tile).cogroup(asked.groupBy(*tile)).applyInArrow(_nearest(k), "feature int, row long, near array<double>")
        far = near.groupBy("feature", "row").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near")).select(
            "feature", "row", F.coalesce(F.get("near", F.lit(k - 1)), F.lit(float("inf"))).alias("far"))
        joined = open_.join(far, ["feature", "row"], "left")
        for axis, g, value in ((F.col("feature"), "gx", "x"), (F.lit(len(names)), "gy", "y")):
            for side, at in (("low", F.greatest(F.lit(0), F.col(g) - reach)), ("high", F.least(F.lit(grid - 1), F.col(g) + reach))):
                edge = table.select(F.col("axis").alias("_a"), F.col("g").alias("_g"), F.col(side).alias(f"{value}_{side}"))
                joined = joined.join(edge, (F.col("_g") == at) & (F.col("_a") == axis), "left").drop("_a", "_g")
        room = F.least(*[F.coalesce(c, F.lit(float("inf"))) for c in (
            F.col("x") - F.col("x_low"), F.col("x_high") - F.col("x"), F.col("y") - F.col("y_low"), F.col("y_high") - F.col("y"))])
        judged = written(joined.select(*points.columns, F.coalesce("far", F.lit(float("inf"))).alias("far"),
                                       (F.coalesce("far", F.lit(float("inf"))) <= room).alias("sure")), "kth")
        found.append(judged.where("sure").select("feature", "row", "far"))
        open_ = judged.where("NOT sure").select(*points.columns)
        if reach >= grid or open_.isEmpty():
            break
        reach *= 2
    if reach >= grid:  # all tiles were asked: what is left has fewer than k others
        found.append(judged.where("NOT sure").select("feature", "row", "far"))
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return written(out, "distances")


def _along(points: DataFrame, far: DataFrame, value: str, g: str, edges: DataFrame) -> DataFrame:
    """(feature, row, n): points of the feature, the row itself included, nearer along one axis than its k-th distance."""
    rows = points.join(far, ["feature", "row"])
    # Short of the distance by more than rounding can be: the neighbour itself does not count, equal values do.
    inside = F.greatest(F.lit(0.0), F.col("far") - 1e-12 * (F.col("far") + F.abs(value)))
    ends = F.array(F.struct(F.lit(0).alias("kind"), (F.col(value) - inside).alias("v")), F.struct(F.lit(2).alias("kind"), (F.col(value) + inside).alias("v")))
    asked = rows.select("feature", "row", F.explode(ends).alias("e")).select("feature", "row", "e.kind", "e.v")
    place = F.size(F.filter("cut", lambda c: c < F.col("v")))
    placed = asked.join(edges, "feature").select("feature", "row", "kind", "v", place.alias("g"))
    own = points.select("feature", "row", F.lit(1).alias("kind"), F.col(value).alias("v"), F.col(g).alias("g"))
    order = Window.partitionBy("feature", "g").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = own.unionByName(placed).withColumn("n", F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(order)).where("kind <> 1")
    sizes = own.groupBy("feature", "g").count()
    every = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("cut"))).alias("g")).join(sizes, ["feature", "g"], "left")
    before = Window.partitionBy("feature").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = every.select("feature", "g", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    signed = (F.col("n") + F.col("before")) * F.when(F.col("kind") == 2, 1).otherwise(-1)
    return counted.join(offsets, ["feature", "g"]).groupBy("feature", "row").agg(F.sum(signed).alias("n"))


def knn_information(df: DataFrame, features: Sequence[str], target: str, k: int = NEIGHBOURS, tile: int = TILE) -> DataFrame:
    """(feature, mutual_info, n_rows) in nats of each feature with the label, on rows finite in all of them.

    Columns are scaled by their spread first; a constant one keeps its values.
    Ties are taken as they are, without noise. Fewer than k + 1 rows, and
    estimates below zero, give 0.
    """
    names = list(features)
    wide = written(clean_rows(df.select(*[F.col(c).cast("double").alias(c) for c in names], F.col(target).cast("double").alias("_y")), [*names, "_y"])
                   .withColumn("_row", F.monotonically_increasing_id()), "points")
    cols = [*names, "_y"]
    stats = wide.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    n = stats["n"]
    if n <= k:
        return df.sparkSession.createDataFrame([(c, 0.0, n) for c in names], "feature string, mutual_info double, n_rows long")
    means = {c: (stats[f"m{i}"], stats[f"s{i}"] or 1.0) for i, c in enumerate(cols)}
    grid = max(1, int(np.ceil(np.sqrt(n / tile))))
    fractions = [i / grid for i in range(1, grid)]
    raw = wide.agg(*[F.percentile_approx(c, fractions, 10_000).alias(c) for c in cols]).first() if fractions else None  # grid numbers a column
    edges = {c: (np.array(raw[c]) - means[c][0]) / means[c][1] if raw else np.empty(0) for c in cols}
    points = written(wide.mapInArrow(_long(names, means, edges), "row long, feature int, x double, y double, gx int, gy int"), "long-points")
    far = _kth_distances(points, k, grid, names, edges)
    cuts = lambda of: df.sparkSession.createDataFrame([(i, of(c).tolist()) for i, c in enumerate(names)], "feature int, cut array<double>")
    nx = _along(points, far, "x", "gx", cuts(lambda c: edges[c])).withColumnRenamed("n", "nx")
    ny = _along(points, far, "y", "gy", cuts(lambda c: edges["_y"])).withColumnRenamed("n", "ny")
    psi = nx.join(ny, ["feature", "row"]).groupBy("feature").agg(F.avg(digamma(F.col("nx")) + digamma(F.col("ny"))).alias("psi"), F.count("*").alias("n_rows"))
    value = digamma(F.lit(float(n))) + digamma(F.lit(float(k))) - F.col("psi")
    return psi.select(F.get(F.array(*map(F.lit, names)), F.col("feature")).alias("feature"), F.greatest(F.lit(0.0), value).alias("mutual_info"), "n_rows")
