import duckdb
import pytest
from pyspark.sql import functions as F

from candlewick.operators.evaluate import actual_band_class, confusion_matrix, metric_columns, predicted_recommendation
from candlewick.operators.indicators import BACKEND_PERIODS, raw_features
from candlewick.plans import pipeline as P
from candlewick.plans.queries import PERIODS
from candlewick.sources import store
from candlewick.sources.bars import load_bars, load_gauge


def test_truncation_invariance(spark, sf):
    """Indicators at date t do not change when rows after t are removed."""
    bars, gauge = load_bars(spark, sf), load_gauge(spark, sf)
    cut = "1998-06-30"
    full = raw_features(bars, gauge, BACKEND_PERIODS).where(F.col("Date") <= cut)
    part = raw_features(bars.where(F.col("Date") <= cut), gauge, BACKEND_PERIODS)
    cols = [c for c in full.columns if c not in ("Date", "ticker")]
    a = full.toPandas().sort_values(["ticker", "Date"]).reset_index(drop=True)
    b = part.toPandas().sort_values(["ticker", "Date"]).reset_index(drop=True)
    assert len(a) == len(b) > 0
    for c in cols:
        assert ((a[c] - b[c]).abs().fillna(0) <= 1e-9 * (1 + a[c].abs().fillna(0))).all(), c
        assert (a[c].isna() == b[c].isna()).all(), c


@pytest.mark.parametrize("horizon", ["daily", "weekly", "monthly"])
def test_split_whole_candles_newest_in_test(spark, sf, horizon):
    s = P.split(spark, sf, horizon, PERIODS[horizon])
    both = s.groupBy("group_id").agg(F.countDistinct("part").alias("n")).where("n > 1").count()
    assert both == 0
    firsts = s.groupBy("ticker", "group_id", "part").agg(F.min("Date").alias("first"))
    edge = firsts.groupBy("ticker").agg(
        F.max(F.when(F.col("part") == "train", F.col("first"))).alias("last_train"),
        F.min(F.when(F.col("part") == "test", F.col("first"))).alias("first_test")).toPandas()
    assert (edge.last_train < edge.first_test).all()


def test_upsert_is_idempotent(spark, sf):
    raw = raw_features(load_bars(spark, sf), load_gauge(spark, sf), BACKEND_PERIODS)
    daily = store.project_horizons(raw)["daily"]
    old = daily.where(F.col("Date") <= "1997-12-31")
    delta = daily.where(F.col("Date") >= "1997-06-01")
    once = store.upsert(old, delta)
    twice = store.upsert(once, delta)
    assert once.count() == daily.count()
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert once.exceptAll(daily).count() == 0


def test_band_rules_and_empty_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (-3.0, -2.0, -1.0), (-1.0, 1.0, 0.5), (5.0, -1.0, 3.0)],
                               "y double, q10 double, q90 double")
    codes = df.select(predicted_recommendation(F.col("q10"), F.col("q90")).alias("p"),
                      actual_band_class(F.col("y"), F.col("q10"), F.col("q90")).alias("a")).collect()
    assert [(r.p, r.a) for r in codes] == [(2, 1), (0, 0), (2, 0), (1, 2)]
    # crossed band (q10 > q90 > 0 > ...) : Short wins when both rules fire
    crossed = spark.createDataFrame([(0.0, 1.0, -1.0)], "y double, q10 double, q90 double")
    assert crossed.select(predicted_recommendation(F.col("q10"), F.col("q90"))).first()[0] == 0
    empty = spark.createDataFrame([], "y double, q10 double, q50 double, q90 double")
    rec = empty.agg(*metric_columns()).first()
    assert rec.n_samples == 0 and rec.confusion_accuracy == 0.0
    cm = confusion_matrix(df.withColumn("horizon", F.lit("h")))
    assert cm.count() == 9 and cm.agg(F.sum("n")).first()[0] == 4


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "target_weekly" in df.columns


@pytest.mark.parametrize("name", ["bars_daily", "rsi", "vix_asof", "features_monthly", "evaluate_all",
                                  "confusion_matrix", "interval_sample", "sync_status"])
def test_registered_query_matches_oracle(spark, sf, name):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = E.queries()[name](spark, sf).toPandas()
    exp = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    cols = sorted(got.columns)
    key = lambda df: sorted(map(str, df[cols].astype(str).itertuples(index=False)))
    assert len(got) == len(exp)
    assert key(got) == key(exp)


def test_learning_curve_final_fit_and_saved_model(spark, sf, tmp_path):
    from candlewick.operators.forest import QuantileForest, best_trees, curve_summary, fit_forest, learning_curve
    from candlewick.operators.labels import group_folds, sample_weight
    from candlewick.plans.queries import TICKERS
    s = P.split(spark, sf, "monthly", PERIODS["monthly"])
    names = [c for c in s.columns if c.startswith(("dist_", "rsi_", "pct_"))]
    train = sample_weight(group_folds(s.where(F.col("part") == "train"), n_splits=2)).checkpoint()
    curve = learning_curve(train, names, "target_monthly", "monthly", TICKERS, 2, trees=10).checkpoint()
    assert curve.count() == 2 * 10 * 3 and curve.where("pinball IS NULL OR pinball <= 0").count() == 0
    trees = best_trees(curve)
    assert trees in range(1, 11) and curve_summary(curve).where("chosen").count() == 1
    sizes = {r.fold: r["count"] for r in train.groupBy("fold").count().collect()}
    assert all(r.n_rows == sizes[r.fold] for r in curve.collect())
    # The curve's points are the losses of forests of as many trees.
    held = train.where("fold = 1")
    for m in (1, 7):
        grown = fit_forest(train.where("fold = 0"), names, "target_monthly", "monthly", TICKERS, trees=10)
        each = grown.by_tree(held, ["target_monthly", "weight"]).collect()
        miss = [(r.target_monthly - sum(e.q10 for e in r._by_tree[:m]) / m, r.weight) for r in each]
        loss = sum(w * max(0.1 * d, -0.9 * d) for d, w in miss) / sum(w for _, w in miss)
        point = curve.where(f"fold = 1 AND trees = {m} AND quantile = 'q10'").first().pinball
        assert point == pytest.approx(loss)
    model = fit_forest(train, names, "target_monthly", "monthly", TICKERS, trees=trees)
    model.save(str(tmp_path))
    loaded = QuantileForest.load(spark, str(tmp_path))
    assert loaded.features == names and loaded.trained_through == train.agg(F.max("Date")).first()[0]
    test = s.where(F.col("part") == "test")
    one, two = (m.predict(test, ["Date", "ticker"]).orderBy("ticker", "Date").collect() for m in (model, loaded))
    assert len(one) == len(two) == test.count()
    assert all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:]) for a, b in zip(one, two, strict=True))
    assert all(r.q10 <= r.q50 <= r.q90 for r in one)


def test_batch_predict_takes_a_forest_of_train_and_test(spark, sf, monkeypatch):
    from candlewick.operators.forest import QuantileForest
    from candlewick.plans import queries
    used, own = {}, QuantileForest.predict
    monkeypatch.setattr(QuantileForest, "predict", lambda self, *a: used.update({self.horizon: self}) or own(self, *a))
    rows = queries.q_batch_predict(spark, sf).collect()
    assert {r.horizon for r in rows} == set(used) == set(queries.HORIZONS) and all(r.in_order and r.in_range for r in rows)
    for h, model in used.items():
        last = {r[0]: r[1] for r in P.split(spark, sf, h, PERIODS[h]).groupBy("part").agg(F.max("Date")).collect()}
        assert model.trained_through == max(last.values()) > last["train"]
