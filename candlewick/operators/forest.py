"""Quantile forest: the three quantiles of a horizon from one set-sized fit.

Spark ML grows the trees once on the weighted rows; the weighted quantiles of
the label in every (tree, leaf) are one aggregate, and a prediction is their
mean over the trees.  No row is collected.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .evaluate import QUANTILES
from .model import HORIZON_PARAMS, SEED, model_frame, model_metadata

TREES = 60
#: Sample weights become whole frequencies: so many for the smallest weight.
WEIGHT_STEPS = 100


class QuantileForest:
    def __init__(self, trees, leaves: DataFrame, horizon: str, features: Sequence[str], tickers: Sequence[str], trained_through):
        self.trees, self.leaves, self.horizon = trees, leaves, horizon
        self.features, self.tickers, self.trained_through = list(features), list(tickers), trained_through

    def _leaves_of(self, df: DataFrame, keep: Sequence) -> DataFrame:
        """``keep`` and ``_leaf``, the number of the row's leaf in every tree."""
        out = self.trees.transform(model_frame(df, self.features, self.tickers))
        return out.select(*keep, F.transform(vector_to_array("_leafv"), lambda leaf: leaf.cast("int")).alias("_leaf"))

    def by_tree(self, df: DataFrame, keep: Sequence) -> DataFrame:
        """``keep`` and ``_by_tree``: the leaf quantiles of the row in each tree, in tree order.

        The leaf table has at most trees * 2^depth rows. It travels as one
        array with a fixed place for every leaf, so that no row is shuffled.
        """
        width = 1 << HORIZON_PARAMS[self.horizon]["max_depth"]
        placed = self.leaves.select((F.col("_tree") * width + F.col("_leaf")).cast("int").alias("at"), F.struct(*QUANTILES).alias("q"))
        spine = placed.sparkSession.range(self.trees.getNumTrees * width).select(F.col("id").cast("int").alias("at"))
        table = spine.join(placed, "at", "left").agg(F.sort_array(F.collect_list(F.struct("at", "q"))).alias("t")).select(
            F.transform("t", lambda e: e["q"])).scalar()
        rows = self._leaves_of(df, keep).withColumn("_table", table)
        return rows.withColumn("_by_tree", F.transform("_leaf", lambda leaf, tree: F.get("_table", tree * width + leaf))).drop("_leaf", "_table")

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """M9: the ``keep`` columns with q10, q50 and q90 of every row.

        Unknown tickers take the trees' index for unseen ones (B20).
        """
        mean = lambda q: F.aggregate(F.col("_by_tree"), F.lit(0.0), lambda a, e: a + e[q]) / F.size("_by_tree")
        return self.by_tree(df, keep).select(*keep, *[mean(q).alias(q) for q in QUANTILES])

    def save(self, path: str) -> None:
        """Trees, leaf quantiles and metadata in a folder of their own."""
        spark = self.leaves.sparkSession
        self.trees.write().overwrite().save(os.path.join(path, "trees"))
        self.leaves.write.mode("overwrite").parquet(os.path.join(path, "leaves"))
        meta = [(self.horizon, self.features, self.tickers, self.trained_through)]
        spark.createDataFrame(meta, "horizon string, features array<string>, tickers array<string>, last_trained_through date") \
            .write.mode("overwrite").json(os.path.join(path, "meta"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuantileForest:
        meta = spark.read.schema("horizon string, features array<string>, tickers array<string>, last_trained_through date") \
            .json(os.path.join(path, "meta")).first()
        trees = RandomForestRegressionModel.load(os.path.join(path, "trees"))
        return cls(trees, spark.read.parquet(os.path.join(path, "leaves")), *meta)


def fit_forest(train: DataFrame, features: Sequence[str], target: str, horizon: str, tickers: Sequence[str],
               weight_col: str = "weight", trees: int = TREES) -> QuantileForest:
    """Grow the trees on the weighted rows and take each leaf's weighted label quantiles."""
    p = HORIZON_PARAMS[horizon]
    rows = model_frame(train, features, tickers)
    grown = RandomForestRegressor(
        featuresCol="_features", labelCol=target, weightCol=weight_col, numTrees=trees, maxDepth=p["max_depth"],
        minInstancesPerNode=p["min_leaf"], subsamplingRate=p["subsample"], featureSubsetStrategy=str(p["colsample"]),
        leafCol="_leafv", predictionCol="_mean", seed=SEED).fit(rows)
    last = model_metadata(train, horizon, features, tickers).first()["last_trained_through"]
    model = QuantileForest(grown, None, horizon, features, tickers, last)
    least = rows.agg(F.min(weight_col)).scalar()
    times = F.round(F.col(weight_col) / least * WEIGHT_STEPS).cast("long")
    placed = model._leaves_of(train.withColumn("_times", times), [F.col(target).alias("_y"), "_times"]).select(
        "_y", "_times", F.posexplode("_leaf").alias("_tree", "_leaf"))
    levels = F.array(*[F.lit(a) for a in QUANTILES.values()])
    found = placed.groupBy("_tree", "_leaf").agg(F.percentile("_y", levels, F.col("_times")).alias("_q"))
    model.leaves = found.select("_tree", "_leaf", *[F.col("_q")[i].alias(q) for i, q in enumerate(QUANTILES)])
    return model


def learning_curve(folds: DataFrame, features: Sequence[str], target: str, horizon: str, tickers: Sequence[str], n_folds: int,
                   weight_col: str = "weight", trees: int = TREES) -> DataFrame:
    """(fold, quantile, trees, n_rows, pinball) for every number of
    trees from 1 on: the weighted pinball loss on the fold of the mean of that
    many trees, grown on the other folds.

    Each held row carries the running means of its trees' quantiles as one
    array, so a fold needs one pass whatever the number of trees, and all folds
    are one aggregate. The folds' forests are grown side by side. ``folds`` has
    the columns fold and weight_col (``labels.group_folds``,
    ``labels.sample_weight``).
    """
    def held(k: int) -> DataFrame:
        model = fit_forest(folds.where(F.col("fold") != k), features, target, horizon, tickers, weight_col, trees)
        model.leaves = written(model.leaves, f"leaves-{horizon}-{k}")
        return model.by_tree(folds.where(F.col("fold") == k), [F.lit(k).alias("fold"), F.col(target).alias("_y"), F.col(weight_col).alias("_w")])

    with ThreadPoolExecutor(max_workers=n_folds) as pool:
        rows = functools.reduce(DataFrame.unionByName, pool.map(held, range(n_folds)))
    start = ", ".join(f"0.0D AS {q}" for q in QUANTILES)
    add = ", ".join(f"s.{q} + e.{q} AS {q}" for q in QUANTILES)
    running = F.expr(f"""aggregate(_by_tree, struct(struct({start}) AS s, CAST(array() AS ARRAY<STRUCT<{', '.join(f'{q}: DOUBLE' for q in QUANTILES)}>>) AS l),
        (a, e) -> struct({_after('a.s', add)} AS s, concat(a.l, array({_after('a.s', add)})) AS l), a -> a.l)""")
    sums = rows.select("fold", "_y", "_w", F.posexplode(running).alias("_at", "_sum"))
    parts = []
    for q, level in QUANTILES.items():
        miss = F.col("_y") - F.col(f"_sum.{q}") / (F.col("_at") + 1)
        parts.append(F.struct(F.lit(q).alias("quantile"), F.greatest(level * miss, (level - 1) * miss).alias("loss")))
    losses = sums.select("fold", "_w", (F.col("_at") + 1).alias("trees"), F.inline(F.array(*parts)))
    return losses.groupBy("fold", "quantile", "trees").agg(
        F.count("*").alias("n_rows"), (F.sum(F.col("loss") * F.col("_w")) / F.sum("_w")).alias("pinball"))


def _after(state: str, add: str) -> str:
    return f"struct({add.replace('s.', f'{state}.')})"


def curve_summary(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For every number of trees the loss, mean over folds and quantiles,
    its spread over folds, and whether it is the chosen number: the least loss,
    fewest trees among equals."""
    folds = curve.groupBy(*by, "trees", "fold").agg(F.avg("pinball").alias("_loss"))
    means = folds.groupBy(*by, "trees").agg(F.avg("_loss").alias("loss"), F.stddev_samp("_loss").alias("spread"), F.count("*").alias("n_folds"))
    first = Window.partitionBy(*by, F.lit(1)).orderBy("loss", "trees")  # one row a number of trees
    return means.withColumn("chosen", F.row_number().over(first) == 1)


def best_trees(curve: DataFrame) -> int:
    """M7: the number of trees with the least mean loss over folds and quantiles."""
    return curve_summary(curve).where("chosen").first()["trees"]
