import pytest

from candlewick.plans import report
from candlewick.sources.bars import BAR_SCHEMA, read_tickers

SCORED = [("weekly", "A", "2020-01-03", 1.0, -1.0, 0.5, 2.0), ("weekly", "B", "2020-01-10", -3.0, -1.0, 0.5, 2.0),
          ("daily", "A", "2020-01-03", 0.2, 0.1, 0.3, 0.4), ("daily", "A", "2020-01-06", None, 0.1, 0.3, 0.4)]


def test_records_keep_nulls_and_bad_lines_raise(spark, tmp_path):
    df = spark.createDataFrame([("a|b", None, 1.5), ("c", 2, None)], "name string, n int, x double")
    path = f"file://{tmp_path}/records"
    report.write_records(df, path)
    assert all("null" in r.value for r in spark.read.text(path).collect())
    assert sorted(map(tuple, report.read_records(spark, path, df.schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(path)
    with pytest.raises(Exception, match="(?i)malformed"):
        report.read_records(spark, path, df.schema).collect()


def test_markdown_is_one_table_in_order(spark, tmp_path):
    df = spark.createDataFrame([("b|c", 1234.56789), ("a", None)], "name string, x double").repartition(3)
    report.write_markdown(df, f"file://{tmp_path}/md", "Title", ["name"], 2)
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/md").collect()]
    assert lines == ["# Title", "", "| name | x |", "| --- | --- |", "| a |  |", "| b\\|c | 1,234.57 |"]


def test_the_test_stage_writes_every_report(spark, tmp_path):
    scored = spark.createDataFrame(SCORED, "horizon string, ticker string, Date string, y double, q10 double, q50 double, q90 double").dropna()
    paths = report.test_stage(scored, f"file://{tmp_path}/run")
    assert set(paths) == {"metrics", "confusion", "sample", "residuals", "summary"}
    metrics = {r.horizon: r for r in spark.read.json(paths["metrics"]).collect()}
    assert metrics["weekly"].n_samples == 2 and metrics["weekly"].coverage == 0.5
    sums = {r.horizon: r["sum(n)"] for r in spark.read.option("header", True).option("inferSchema", True).csv(paths["confusion"]).groupBy("horizon").sum("n").collect()}
    assert sums == {"weekly": 2, "daily": 1}
    assert spark.read.option("header", True).csv(paths["sample"]).count() == 3
    assert spark.read.text(paths["summary"]).first().value == "# Test metrics"


def test_ticker_files_are_one_scan_and_missing_ones_raise(spark, tmp_path):
    row = "DATE '2020-01-02' AS Date, 1.0D AS Open, 2.0D AS High, 0.5D AS Low, 1.5D AS Close"
    spark.sql(f"SELECT {row}, 10.0D AS Volume").write.parquet(f"file://{tmp_path}/A B.parquet")
    spark.sql(f"SELECT 'own' AS ticker, {row}, 1 AS extra").write.parquet(f"file://{tmp_path}/C.parquet")
    spark.sql(f"SELECT CAST(NULL AS STRING) AS ticker, {row}, CAST(7 AS INT) AS Volume2").write.parquet(f"file://{tmp_path}/D.parquet")
    df = read_tickers(spark, f"file://{tmp_path}", ["A B", "C", "D"])
    assert df.schema == BAR_SCHEMA and df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted((r.ticker, r.Volume) for r in df.collect()) == [("A B", 10.0), ("D", None), ("own", None)]
    with pytest.raises(FileNotFoundError, match="X, Z"):
        read_tickers(spark, f"file://{tmp_path}", ["C", "Z", "X"])
