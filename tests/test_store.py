import tempfile

import pytest
from pyspark.sql import functions as F

from candlewick.operators import incremental
from candlewick.operators.indicators import BACKEND_PERIODS, daily_frame, raw_features
from candlewick.plans import pipeline as P
from candlewick.session import ensure_checkpoint_dir
from candlewick.sources import store, versions
from candlewick.sources.bars import load_bars, load_gauge
from candlewick.streaming.sync import sync_batch


def equal(got, want):
    cols = want.columns
    near = lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.select(*cols).dtypes])
    assert got.count() == want.count() > 0
    assert near(got).exceptAll(near(want)).count() == 0


def whole_store(bars, gauge):
    return store.project_horizons(raw_features(bars, gauge, BACKEND_PERIODS))


@pytest.fixture
def root(spark):
    ensure_checkpoint_dir(spark)
    return "file:" + tempfile.mkdtemp(prefix="cw-store-")


@pytest.mark.parametrize("scheme", ["", "file:"])
def test_init_tables_keeps_rows(spark, sf, scheme):
    root = scheme + tempfile.mkdtemp(prefix="cw-store-")
    store.init_tables(spark, root)
    columns = [c for c in store.store_schema("daily").names if c not in store.KEYS]
    daily = spark.range(5).selectExpr("'AF' AS ticker", "date_add(DATE '2020-01-01', CAST(id AS INT)) AS Date", *[f"CAST(id AS DOUBLE) AS {c}" for c in columns])
    store.write_horizons({"daily": daily}, root)
    store.init_tables(spark, root)
    assert store.open_store(spark, root)["daily"].count() == 5
    assert store.open_store(spark, root)["weekly"].count() == 0


def test_batches_lose_no_row_and_corrections_reach_every_table(spark, sf, root):
    bars, gauge = load_bars(spark, sf).checkpoint(), load_gauge(spark, sf)
    some = F.col("ticker").isin("AF", "NO")
    bars = bars.where(some)
    sync_batch(bars.where("Date <= '2000-06-30'"), root, gauge)
    sync_batch(bars.where("Date > '2000-06-30'"), root, gauge)
    for h, want in whole_store(bars, gauge).items():
        equal(store.open_store(spark, root)[h], want)
    late = bars.where("ticker = 'AF' AND Date BETWEEN '2000-05-01' AND '2000-05-10'").limit(1).withColumn("Close", F.col("Close") + 5)
    late = late.checkpoint()
    sync_batch(late, root, gauge)
    for h, want in whole_store(store.upsert(bars, late), gauge).items():
        equal(store.open_store(spark, root)[h], want)


def test_sync_touches_stale_tickers_only(spark, sf, root):
    daily = daily_frame(load_bars(spark, sf), load_gauge(spark, sf)).where("ticker IN ('AF', 'NO')").checkpoint()
    old = daily.where("ticker = 'AF' OR Date <= '1999-01-01'")
    store.init_tables(spark, root)
    marked = store.project_horizons(raw_features(old, None, BACKEND_PERIODS))
    marked["daily"] = marked["daily"].withColumn("close_daily_last", F.when(F.col("ticker") == "AF", F.lit(-1.0)).otherwise(F.col("close_daily_last")))
    store.write_horizons(marked, root)
    status = {r.ticker: r.is_synced for r in store.sync_status(daily, store.open_store(spark, root)).collect()}
    assert status == {"AF": True, "NO": False}
    store.sync_store(spark, root, daily)
    table = store.open_store(spark, root)["daily"]
    assert table.where("ticker = 'AF' AND close_daily_last <> -1").count() == 0
    equal(table.where("ticker = 'NO'"), store.project_horizons(raw_features(daily, None, BACKEND_PERIODS))["daily"].where("ticker = 'NO'"))


def scans(df, table):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count(f"{table}.parquet")


def test_line_items_are_scanned_once(spark, sf):
    plan = load_bars(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SortAggregate" not in plan and "Sort " not in plan
    assert plan.count("HashAggregate") == 2
    P.clear_stages()
    from candlewick.plans.queries import registry
    for name in ("rsi", "retrain_flag", "market_snapshot"):
        assert scans(registry()[name](spark, sf), "lineitem") == 0  # they read the materialized bars


def test_lines_of_a_weekend_count_to_friday_and_wide_keys_raise(spark):
    rows = [("A", "F", "2024-03-01", 2.0, 20.0, 1, 1, 1, 1), ("A", "F", "2024-03-02", 1.0, 30.0, 2, 1, 1, 1), ("A", "F", "2024-03-03", 1.0, 5.0, 2, 2, 1, 1)]
    schema = ("l_returnflag string, l_linestatus string, l_shipdate string, l_quantity double, l_extendedprice double, "
              "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    from candlewick.sources.bars import bars_from_lineitem
    r = bars_from_lineitem(spark.createDataFrame(rows, schema)).collect()
    assert [(str(x.Date), x.Open, x.High, x.Low, x.Close, x.Volume) for x in r] == [("2024-03-01", 10.0, 30.0, 5.0, 5.0, 4.0)]
    wide = [("A", "F", "2024-03-01", 2.0, 20.0, 10 ** 14, 1, 1, 1)]
    with pytest.raises(Exception, match="too many digits"):
        bars_from_lineitem(spark.createDataFrame(wide, schema)).collect()


def test_stages_follow_their_input(spark, sf):
    """Data appended to the folder during a session is seen."""
    folder = tempfile.mkdtemp(prefix="cw-input-")
    lines, orders = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "orders"))
    orders.write.parquet(f"{folder}/orders.parquet")
    lines.where("l_orderkey % 2 = 0").write.parquet(f"{folder}/lineitem.parquet")
    before = P.bars(spark, folder).agg(F.sum("Volume")).first()[0]
    lines.where("l_orderkey % 2 = 1").write.mode("append").parquet(f"{folder}/lineitem.parquet")
    after = P.bars(spark, folder).agg(F.sum("Volume")).first()[0]
    assert before < after == lines.agg(F.sum("l_quantity")).first()[0]


@pytest.fixture(scope="module")
def six(spark, sf):
    """Bars of two tickers and their gauge."""
    return load_bars(spark, sf).where("ticker IN ('AF', 'NO')").checkpoint(), load_gauge(spark, sf).checkpoint()


def test_a_sync_reads_no_bars_before_the_state(spark, six, root):
    bars, gauge = six
    sync_batch(bars.where("Date <= '2001-06-30'"), root, gauge)
    new = daily_frame(bars.where("Date > '2001-06-30'"), gauge)
    held = versions.latest(spark, root)
    state = store.read_state(spark, held, new)
    years = {int(part.split("year=")[1].split("/")[0]) for part in state.daily.inputFiles()}
    held_years = {y for y, _ in held.tables["daily_state"]}
    assert min(held_years) <= 1996 and min(years) >= 1999
    done = incremental.advance(new, state, BACKEND_PERIODS)
    # What is written of old years is not touched by the commit either.
    after = store.apply_bars(spark, root, new)
    changed = {part for part, run in after.tables["daily"].items() if held.tables["daily"].get(part) != run}
    assert {y for y, _ in changed} == {2001}
    assert done.features.agg(F.min("Date")).first()[0] == new.agg(F.min("Date")).first()[0]


def test_many_small_batches_equal_one_full_computation(spark, six, root):
    """Day by day over week and month ends, short periods, with a dormant ticker and bars that come late."""
    bars, gauge = six
    bars = bars.where("Date BETWEEN '2000-01-01' AND '2000-12-31'").checkpoint()
    periods = (3, 5)
    late = F.col("Date").isin("2000-11-02", "2000-12-05")
    sync_batch(bars.where("Date <= '2000-11-20'").where(~late), root, gauge, periods)
    for day in ("2000-11-24", "2000-11-29", "2000-12-01", "2000-12-04"):
        known = store.open_store(spark, root, periods)["daily"].agg(F.max("Date")).first()[0]
        sync_batch(bars.where((F.col("Date") > known) & (F.col("Date") <= day) & ((F.col("ticker") == "AF") | (F.col("Date") <= "2000-11-24"))), root, gauge, periods)
    sync_batch(bars.where(F.col("Date") > "2000-12-04").unionByName(bars.where("ticker = 'NO' AND Date > '2000-11-24' AND Date <= '2000-12-04'")).where(~late), root, gauge, periods)
    sync_batch(bars.where(late), root, gauge, periods)
    for h, want in store.project_horizons(raw_features(bars, gauge, periods), periods).items():
        equal(store.open_store(spark, root, periods)[h], want)


def test_a_writer_that_dies_before_the_commit_leaves_the_old_version(spark, six, root, monkeypatch):
    bars, gauge = six
    bars = bars.where("Date >= '2001-01-01'").checkpoint()
    sync_batch(bars.where("Date <= '2001-05-31'"), root, gauge)
    before = {h: t.count() for h, t in store.open_store(spark, root).items()}
    pinned = store.open_store(spark, root)
    whole = versions.write_partitions

    def dies(df, base, table, year):
        if table == "weekly":
            raise OSError("lost")
        return whole(df, base, table, year)

    monkeypatch.setattr(versions, "write_partitions", dies)
    daily = daily_frame(bars, gauge)
    with pytest.raises(OSError, match="lost"):
        store.sync_store(spark, root, daily)
    monkeypatch.undo()
    assert {h: t.count() for h, t in store.open_store(spark, root).items()} == before
    assert not any(r.is_synced for r in store.sync_status(daily, store.open_store(spark, root)).collect())
    store.sync_store(spark, root, daily)
    assert all(r.is_synced for r in store.sync_status(daily, store.open_store(spark, root)).collect())
    for h, want in whole_store(bars, gauge).items():
        equal(store.open_store(spark, root)[h], want)
    assert {h: t.count() for h, t in pinned.items()} == before  # a reader keeps the version it opened
    assert versions.vacuum(spark, root, keep=1) > 0
    equal(store.open_store(spark, root)["monthly"], whole_store(bars, gauge)["monthly"])


def test_replayed_batches_and_second_writers_change_nothing(spark, six, root):
    bars, gauge = six
    bars = bars.where("Date >= '2001-06-01'").checkpoint()
    first = sync_batch(bars.where("Date <= '2001-07-31'"), root, gauge, number=("bars", 0))
    again = sync_batch(bars.where("Date <= '2001-07-31'"), root, gauge, number=("bars", 0))
    assert again.number == first.number
    second = sync_batch(bars.where("Date > '2001-07-31'"), root, gauge, number=("bars", 1))
    assert second.number == first.number + 1 and second.batches == {"bars": 1}
    with pytest.raises(versions.ConcurrentCommit):
        versions.commit(spark, first, {})


def test_status_is_that_of_the_table_most_behind(spark):
    day = lambda t, d: spark.createDataFrame([(t, d)], "ticker string, Date string").select("ticker", F.to_date("Date").alias("Date"))
    source = day("A", "2020-01-03").unionByName(day("B", "2020-01-03"))
    tables = {"daily": source, "weekly": day("A", "2020-01-02").unionByName(day("B", "2020-01-03")), "monthly": day("A", "2020-01-03")}
    got = {r.ticker: (str(r.db_latest), r.is_synced) for r in store.sync_status(source, tables).collect()}
    assert got == {"A": ("2020-01-02", False), "B": ("None", False)}


def test_the_later_of_two_rows_of_a_key_wins(spark, sf, root):
    table = spark.createDataFrame([("A", 1, 1.0)], "ticker string, Date int, Close double")
    delta = spark.createDataFrame([("A", 1, 7.0, 2), ("A", 1, 9.0, 1), ("B", 1, None, 5), ("B", 1, 3.0, None), ("C", 1, 4.0, 1), ("C", 1, 5.0, 1)],
                                  "ticker string, Date int, Close double, at int")
    got = store.upsert(table, delta.repartition(3), latest_by=["at"]).collect()
    assert sorted(map(tuple, got)) == [("A", 1, 7.0), ("B", 1, None), ("C", 1, 5.0)]


def test_unknown_tickers_raise(spark):
    held = spark.createDataFrame([("A",), ("B",)], "ticker string")
    assert store.known_tickers(held.limit(1), held).count() == 1
    with pytest.raises(KeyError, match="Z"):
        store.known_tickers(held.unionByName(spark.createDataFrame([("Z",)], "ticker string")), held)
