import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewick.functions.calendar import week_id
from candlewick.operators.eda import missing_report
from candlewick.operators.features import history_filter
from candlewick.operators.indicators import raw_features
from candlewick.sources.bars import load_bars, load_gauge
from candlewick.sources.store import normalize_ticker, unknown_tickers


def test_candle_end_sma_equals_period_mean(spark, sf):
    """On the last row of a week, sma_weekly_p is the mean of the last p weekly closes."""
    p = 10
    raw = raw_features(load_bars(spark, sf), load_gauge(spark, sf), (p,), blocks=["sma"])
    bars = load_bars(spark, sf).withColumn("wk", week_id(F.col("Date")))
    closes = bars.groupBy("ticker", "wk").agg(F.max_by("Close", "Date").alias("c"), F.max("Date").alias("Date"))
    w = Window.partitionBy("ticker").orderBy("wk").rowsBetween(-(p - 1), 0)
    exp = closes.select("ticker", "Date", F.when(F.count("c").over(w) == p, F.avg("c").over(w)).alias("exp"))
    got = raw.join(exp, ["ticker", "Date"]).select("exp", f"sma_weekly_{p}").toPandas().dropna()
    assert len(got) > 50
    assert ((got["exp"] - got[f"sma_weekly_{p}"]).abs() <= 1e-9 * got["exp"].abs()).all()


def test_history_filter_and_unknown_tickers(spark, sf):
    bars = load_bars(spark, sf)
    kept = history_filter(bars, "monthly", "1998-01-01")
    assert kept.agg(F.min("Date")).first()[0] >= pd.Timestamp("1998-01-01").date()
    req = spark.createDataFrame([("AF",), ("ZZ",)], "ticker string")
    assert [r.ticker for r in unknown_tickers(req, bars).collect()] == ["ZZ"]
    names = spark.createDataFrame([("^TA125.TA",), ("^GDAXI",)], "t string")
    assert [r[0] for r in names.select(normalize_ticker(F.col("t"))).collect()] == ["TA125_TA", "GDAXI"]


def test_missing_report_counts_and_order(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (None, None, "b"), (3.0, 1.0, None), (4.0, 2.0, "d")],
                               "x double, y double, s string")
    rep = missing_report(df).toPandas()
    assert list(rep["column"]) == ["y", "s", "x"]
    assert list(rep["missing"]) == [2, 1, 1]
    assert list(rep["missing_pct"]) == [50.0, 25.0, 25.0]


def test_unknown_horizon_rejected(spark, sf):
    from candlewick.operators.features import select_horizon_columns
    with pytest.raises(ValueError, match="no such horizon"):
        select_horizon_columns(load_bars(spark, sf), "hourly")


def test_gauge_asof_carries_across_years(spark):
    from candlewick.operators.indicators import gauge_asof
    d = lambda s: pd.Timestamp(s).date()
    dates = spark.createDataFrame([(d("2020-12-29"),), (d("2020-12-31"),), (d("2021-01-04"),),
                                   (d("2022-03-01"),), (d("2022-03-03"),)], "Date date")
    gauge = spark.createDataFrame([(d("2020-12-30"), 5.0), (d("2022-03-02"), 7.0)], "Date date, Close double")
    got = {r.Date.isoformat(): r.vix_close for r in gauge_asof(dates, gauge).collect()}
    assert got == {"2020-12-29": None, "2020-12-31": 5.0, "2021-01-04": 5.0, "2022-03-01": 5.0, "2022-03-03": 7.0}


def test_ordered_position_exact_with_ties(spark):
    """Bucketed ranking equals a plain sort even when many equal values straddle bucket edges."""
    import numpy as np
    from candlewick.operators.sampling import ordered_position
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"g": rng.integers(0, 2, n).astype(str), "y": rng.integers(0, 40, n).astype(float),
                        "k": np.arange(n)})
    got = ordered_position(spark.createDataFrame(pdf), ["g"], "y", ["k"], buckets=16).toPandas()
    exp = pdf.sort_values(["g", "y", "k"]).copy()
    exp["position"] = exp.groupby("g").cumcount()
    m = got.merge(exp, on=["g", "k"], suffixes=("", "_exp"))
    assert len(m) == n and (m["position"] == m["position_exp"]).all()
