import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.functions.calendar import week_id, weekdays_to_month_end
from candlewick.operators.indicators import BACKEND_PERIODS, raw_features
from candlewick.operators.seq import ewm_mean
from candlewick.sources.bars import load_bars, load_gauge
from pandas_model import model_series


def _bars_pd(sf):
    day = "cast(l_shipdate as date)"
    key = "(l_orderkey,l_linenumber,l_partkey,l_suppkey)"
    return duckdb.sql(f"""select l_returnflag||l_linestatus ticker, cast({day} - greatest(isodow({day}) - 5, 0)::int as date) Date,
     arg_min(l_extendedprice/l_quantity,{key}) Open,
     max(l_extendedprice/l_quantity) High, min(l_extendedprice/l_quantity) Low,
     arg_max(l_extendedprice/l_quantity,{key}) Close,
     sum(l_quantity) Volume from '{sf}/lineitem.parquet' group by all""").df()


def test_raw_features_match_pandas_model(spark, sf):
    sp = raw_features(load_bars(spark, sf), load_gauge(spark, sf), BACKEND_PERIODS).toPandas()
    g = duckdb.sql(f"select cast(o_orderdate as date) Date, avg(o_totalprice) Close from '{sf}/orders.parquet' "
                   "group by all order by 1").df()
    gauge = pd.Series(g.Close.values, index=pd.to_datetime(g.Date))
    bars = _bars_pd(sf)
    assert sorted(sp.ticker.unique()) == sorted(bars.ticker.unique())
    for t, b in bars.groupby("ticker"):
        b = b.set_index(pd.to_datetime(b.Date)).sort_index()
        m = model_series(b, gauge, BACKEND_PERIODS)
        s = sp[sp.ticker == t].copy()
        s = s.set_index(pd.to_datetime(s.Date)).sort_index()
        assert len(s) == len(m)
        for col in m.columns:
            a, e = s[col].astype(float).to_numpy(), m[col].astype(float).to_numpy()
            assert (np.isnan(a) == np.isnan(e)).all(), (t, col)
            ok = ~np.isnan(a)
            np.testing.assert_allclose(a[ok], e[ok], rtol=1e-9, atol=1e-9, err_msg=f"{t} {col}")


@pytest.mark.parametrize("p", [10, 14, 50, 200])
def test_ewm_scan_matches_pandas(spark, p):
    rng = np.random.default_rng(p)
    n = 700
    x = rng.lognormal(3, 0.5, n)
    x[:3] = np.nan                      # leading missing values are skipped
    pdf = pd.DataFrame({"k": "a", "i": np.arange(n), "x": x})
    df = spark.createDataFrame(pdf)
    alpha = 2.0 / (p + 1) if p != 14 else 1.0 / 14
    out = ewm_mean(df, [("y", "x", alpha)], ("k",), "i").orderBy("i").toPandas()
    exp = pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    got = out["y"].astype(float).to_numpy()
    assert np.isnan(got[:3]).all()
    np.testing.assert_allclose(got[3:], exp[3:], rtol=1e-12)


def test_ewm_of_a_long_series_whichever_output_is_read(spark):
    n = 70_000
    rng = np.random.default_rng(0)
    x, z = rng.lognormal(3, 0.5, n), rng.normal(0, 1, n)
    z[rng.integers(0, n, 500)] = np.nan
    z[:700] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": np.arange(n), "x": x, "z": z})).selectExpr("k", "i", "x", "nanvl(z, null) AS z")
    out = ewm_mean(df, [("y", "x", 2 / 201), ("g", "z", 1 / 14), ("f", "x", 2 / 3)], ("k",), "i")
    seen = pd.Series(z).dropna().ewm(alpha=1 / 14, adjust=False).mean()
    want = {"y": pd.Series(x).ewm(alpha=2 / 201, adjust=False).mean(), "g": seen.reindex(range(n)).ffill(),
            "f": pd.Series(x).ewm(alpha=2 / 3, adjust=False).mean()}
    for name, values in want.items():
        got = out.select("i", name).orderBy("i").toPandas()[name].astype(float).to_numpy()
        np.testing.assert_allclose(got, values.to_numpy(), rtol=1e-12, atol=1e-13)


def test_rsi_edge_cases(spark):
    # flat series: no gain and no loss -> RSI missing; rising series: no loss -> 100
    days = pd.bdate_range("2020-01-01", periods=40)
    rows = [("FLAT", d.date(), 10.0, 10.0, 10.0, 10.0, 1.0) for d in days]
    rows += [("UP", d.date(), 10.0 + i, 10.0 + i, 10.0 + i, 10.0 + i, 1.0) for i, d in enumerate(days)]
    bars = spark.createDataFrame(rows, "ticker string, Date date, Open double, High double, Low double, Close double, Volume double")
    out = raw_features(bars, None, (10,), blocks=["rsi"]).toPandas()
    flat, up = out[out.ticker == "FLAT"], out[out.ticker == "UP"]
    assert flat["rsi_daily"].isna().all()
    assert (up["rsi_daily"].dropna() == 100.0).all() and up["rsi_daily"].notna().sum() == 39


def test_single_candle_ticker_and_gauge_after_first_bar(spark):
    rows = [("ONE", pd.Timestamp("2021-01-04").date(), 1.0, 2.0, 0.5, 1.5, 10.0)]
    bars = spark.createDataFrame(rows, "ticker string, Date date, Open double, High double, Low double, Close double, Volume double")
    gauge = spark.createDataFrame([(pd.Timestamp("2021-01-05").date(), 20.0)], "Date date, Close double")
    out = raw_features(bars, gauge, (10,)).toPandas()
    assert len(out) == 1
    r = out.iloc[0]
    assert r.close_weekly_last != r.close_weekly_last  # NaN: no closed candle
    assert r.pct_change_week_current == pytest.approx(50.0)
    assert r.volume_week_current == 10.0 and r.volume_week_prev != r.volume_week_prev


def test_calendar_keys_and_business_days(spark):
    days = pd.date_range("2000-01-01", "2003-12-31")
    df = spark.createDataFrame(pd.DataFrame({"d": days.date}))
    got = df.select("d", week_id(F.col("d")).alias("w"), weekdays_to_month_end(F.col("d")).alias("n")).toPandas()
    got = got.set_index(pd.to_datetime(got.d)).sort_index()
    iso = days.isocalendar()
    np.testing.assert_array_equal(got.w.to_numpy(), (iso.year * 100 + iso.week).to_numpy())
    start = (days + pd.Timedelta(days=1)).values.astype("datetime64[D]")
    end = ((days + pd.offsets.MonthEnd(0)) + pd.Timedelta(days=1)).values.astype("datetime64[D]")
    np.testing.assert_array_equal(got.n.to_numpy(), np.busday_count(start, end))
    assert got.loc["2021-01-03":"2021-01-03"].empty  # range check only
