import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.operators.indicators import raw_features
from candlewick.operators.ranges import asof_join, blocked, row_numbers, series_windows
from candlewick.sources.bars import load_bars, load_gauge


@pytest.fixture(scope="module")
def long_series(spark):
    """One series of 70,000 rows, a short one, gaps in the input, bursts in time."""
    at = F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") + 10_000_000)
    big = spark.range(70_000).select(F.lit("a").alias("k"), at.alias("t"), F.when(F.col("id") % 11 != 0, F.sin("id") * 100).alias("x"))
    small = spark.range(30).select(F.lit("b").alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    return big.unionByName(small).repartition(8).checkpoint()


def test_row_numbers_are_exact(long_series):
    got = row_numbers(long_series, ["k"], "t").toPandas().sort_values(["k", "t"])
    for _, rows in got.groupby("k"):
        assert rows["_rn"].tolist() == list(range(len(rows)))


def test_no_block_holds_the_series(long_series):
    sizes = blocked(long_series, ["k"], "t", 1000, 199, 32).groupBy("k", "__block").agg(F.count("*").alias("n"), F.count_if("__own").alias("own")).collect()
    assert max(r.n for r in sizes) <= 1000 + 199 + 32 and max(r.own for r in sizes) <= 1000 and sum(r.own > 0 for r in sizes) == 71


def test_windows_equal_the_plain_ones(long_series):
    rolling = [("r", "avg", "x", 200, 200), ("s", "stddev_samp", "x", 50, 10), ("m", "min", "x", 7, 1)]
    got = series_windows(long_series, ["k"], "t", rolling, [("before", "x", 3), ("after", "x", -2)],
                         [("total", "sum", "x"), ("low", "min", "x"), ("n", "count", "x")], rows=500).toPandas()
    assert len(got) == 70_030
    for _, g in got.sort_values(["k", "t"]).groupby("k"):
        x = g["x"].astype(float)
        assert np.allclose(g["r"].astype(float), x.rolling(200, min_periods=200).mean(), equal_nan=True)
        assert np.allclose(g["s"].astype(float), x.rolling(50, min_periods=10).std(), equal_nan=True)
        assert np.allclose(g["m"].astype(float), x.rolling(7, min_periods=1).min(), equal_nan=True)
        assert np.allclose(g["before"].astype(float), x.shift(3), equal_nan=True) and np.allclose(g["after"].astype(float), x.shift(-2), equal_nan=True)
        assert np.allclose(g["total"].astype(float), x.cumsum(), equal_nan=True) and np.allclose(g["low"].astype(float), x.cummin(), equal_nan=True)
        assert (g["n"].dropna().astype(int).tolist() == x.notna().cumsum()[x.notna()].tolist())


def test_indicators_in_blocks_equal_the_plain_ones(spark, sf):
    bars, gauge = load_bars(spark, sf), load_gauge(spark, sf)
    names = ["sma", "volume", "range", "bollinger", "returns"]
    plain = raw_features(bars, gauge, (10, 50), blocks=names).toPandas().sort_values(["ticker", "Date"])
    in_blocks = raw_features(bars, gauge, (10, 50), blocks=names, block_rows=100).toPandas().sort_values(["ticker", "Date"])
    assert len(plain) == len(in_blocks) > 0
    for c in plain.columns.drop(["ticker", "Date"]):
        assert np.allclose(plain[c].astype(float), in_blocks[c].astype(float), equal_nan=True, rtol=1e-9), c


def brute_asof(left, right, tolerance, strict):
    out = []
    for key, t, i in left:
        best = None
        for k, s, order, v in right:
            if None not in (key, t, k, s) and k == key and (s < t or (s == t and not strict)) and (tolerance is None or t - s <= tolerance):
                best = max(best or (s, order, v), (s, order, v))
        out.append((i, best[1] if best else None, best[2] if best else None))
    return sorted(out)


@pytest.mark.parametrize("tolerance,strict", [(None, False), ("2 hours", False), ("90 minutes", True), (None, True)])
def test_asof_join_equals_brute_force(spark, tolerance, strict):
    draw, start = random.Random(5), datetime(2024, 3, 1)
    moment = lambda: start + timedelta(minutes=10 * draw.randint(0, 200))
    left = [(draw.choice([1, 1, 1, 2, 3, None]), draw.choice([moment(), moment(), moment(), None]), i) for i in range(300)]
    right = [(draw.choice([1, 1, 2, 4, None]), draw.choice([moment(), moment(), None]), j, draw.random()) for j in range(150)]
    l = spark.createDataFrame(left, "key int, t timestamp, i int")
    r = spark.createDataFrame(right, "key int, s timestamp, ord int, v double")
    got = asof_join(l, r, "t", ["key"], ["ord", "v"], right_on="s", tolerance=tolerance, strict=strict, tie=["ord"], ranges=16)
    width = {None: None, "2 hours": timedelta(hours=2), "90 minutes": timedelta(minutes=90)}[tolerance]
    assert got.columns == ["key", "t", "i", "ord", "v"]
    assert sorted((x.i, x.ord, x.v) for x in got.collect()) == brute_asof(left, right, width, strict)


def test_asof_join_without_keys_and_on_empty_sides(spark):
    l = spark.createDataFrame(pd.DataFrame({"t": [5, 1, 9], "i": [0, 1, 2]}))
    r = spark.createDataFrame(pd.DataFrame({"t": [2, 7], "v": ["a", "b"]}))
    assert {x.i: x.v for x in asof_join(l, r, "t", values=["v"]).collect()} == {0: "a", 1: None, 2: "b"}
    assert {x.i: x.v for x in asof_join(l, r, "t", values=["v"], tolerance="1").collect()} == {0: None, 1: None, 2: None}
    assert {x.i: x.v for x in asof_join(l, r.limit(0), "t", values=["v"]).collect()} == {0: None, 1: None, 2: None}
    assert asof_join(l.limit(0), r, "t", values=["v"]).count() == 0
