import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.operators import eda
from candlewick.operators.information import knn_information
from candlewick.operators.labels import group_folds, lightest_folds
from candlewick.operators.model import label_sketches, merged_quantiles, rank_error


@pytest.mark.parametrize("seed", range(40))
def test_lightest_folds_equal_a_plain_greedy_run(seed):
    draw = random.Random(seed)
    k = draw.randint(2, 6)
    sizes = sorted((draw.choice([1, 1, 2, 3, 5, 17, 40]) for _ in range(draw.randint(k, 120))), reverse=True)
    loads, want = [0] * k, []
    for n in sizes:
        f = loads.index(min(loads))
        loads[f] += n
        want.append(f)
    histogram = sorted({n: sizes.count(n) for n in sizes}.items(), reverse=True)
    got = []
    for (_, first, turns), (_, count) in zip(lightest_folds(histogram, k), histogram, strict=True):
        got += [first[i] if i < len(first) else turns[(i - len(first)) % k] for i in range(count)]
    assert got == want


def test_group_folds_keep_candles_whole_and_loads_near(spark):
    rows = [(t, f"{t}_{i}", f"2020-01-{1 + i % 28:02d}") for t in "AB" for i in range(60) for _ in range(1 + (i * 7) % 13)]
    df = spark.createDataFrame(rows, "ticker string, group_id string, day string").select("ticker", "group_id", F.to_date("day").alias("Date"))
    got = group_folds(df, 4).checkpoint()
    assert got.count() == len(rows)
    assert got.groupBy("group_id").agg(F.count_distinct("fold").alias("n")).where("n <> 1").count() == 0
    loads = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert len(loads) == 4 and max(loads) - min(loads) <= 1
    one = group_folds(df.where("group_id = 'A_0'"))
    assert one.where("fold IS NOT NULL").count() == 0 < one.count()


def test_correlations_are_pairwise_complete(spark):
    draw = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": draw.normal(1e6, 1, 500), "b": draw.normal(size=500), "c": draw.exponential(size=500), "d": 5.0, "e": np.nan})
    pdf["f"] = pdf.a * 2 - pdf.b
    for c, share in (("a", 0.1), ("b", 0.4), ("c", 0.02)):
        pdf.loc[draw.random(500) < share, c] = np.nan
    rows = [tuple(None if v != v else float(v) for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns)).repartition(4)
    got = {(r.feature_1, r.feature_2): r.corr for r in eda.corr_matrix(df, list(pdf.columns)).collect()}
    want = pdf.corr()
    for a in pdf.columns:
        for b in pdf.columns:
            w = want.loc[a, b]
            assert (got[a, b] is None) if w != w else got[a, b] == pytest.approx(w, abs=1e-9), (a, b)
    assert eda.corr_matrix(df.limit(0), ["a", "b"]).where("corr IS NOT NULL").count() == 0


def test_merged_sketches_keep_to_the_rank_error(spark):
    rows = spark.range(200_000).select((F.col("id") % 40).cast("int").alias("month"), F.when(F.col("id") % 3 > 0, "A").otherwise("B").alias("ticker"),
                                       (F.rand(1) * F.rand(2)).alias("y")).checkpoint()
    parts = label_sketches(rows, "y", ["ticker"], F.col("month"), 100)
    assert parts.count() == 80
    found = merged_quantiles(parts.where("period < 30"), ["ticker"], 100)
    window = rows.where("month < 30").toPandas()
    for r in found.collect():
        y = window[window.ticker == r.ticker].y
        assert r.n == len(y)
        for q, a in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)):
            assert abs((y <= r[q]).mean() - a) <= rank_error(100)


def brute_information(x, y, k):
    """Every distance at once, and digamma from harmonic numbers."""
    x, y = (x - x.mean()) / (x.std() or 1.0), (y - y.mean()) / (y.std() or 1.0)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    both = np.maximum(dx, dy)
    np.fill_diagonal(both, np.inf)
    far = np.sort(both, axis=1)[:, k - 1]
    psi = lambda m: sum(1 / i for i in range(1, int(m))) - 0.5772156649015329
    nx, ny = (np.sum(d <= np.maximum(0, far * (1 - 1e-12) - 1e-12 * np.abs(v))[:, None], axis=1) for d, v in ((dx, x), (dy, y)))
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(m) for m in nx]) - np.mean([psi(m) for m in ny]))


@pytest.mark.parametrize("tile", [20, 60, 10_000])
def test_knn_information_equals_brute_force(spark, tile):
    draw = np.random.default_rng(9)
    n = 400
    pdf = pd.DataFrame({"a": draw.normal(size=n), "b": draw.exponential(size=n) ** 3, "c": draw.integers(0, 6, n).astype(float), "d": 2.0})
    pdf["y"] = np.sin(pdf.a * 2) + 0.3 * draw.normal(size=n) + 0.2 * pdf.c
    pdf.loc[:3, "y"] = [40.0, -35.0, 38.0, 40.0]  # far away: their neighbours lie outside of the tiles around them
    got = {r.feature: r for r in knn_information(spark.createDataFrame(pdf).repartition(3), ["a", "b", "c", "d"], "y", 3, tile).collect()}
    for c in "abcd":
        assert got[c].n_rows == n and got[c].mutual_info == pytest.approx(brute_information(pdf[c].to_numpy(), pdf.y.to_numpy(), 3), abs=1e-6), c
    assert got["a"].mutual_info > got["b"].mutual_info


def test_knn_information_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (2.0, float("nan"))], "a double, y double")
    assert [(r.feature, r.mutual_info, r.n_rows) for r in knn_information(df, ["a"], "y").collect()] == [("a", 0.0, 1)]
