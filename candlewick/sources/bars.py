"""Daily bar sources (A1, A2, B5, B6) and the volatility-gauge series.

A bar table is long: one row per (ticker, trading date) with Open, High, Low,
Close, Volume.  Never one table per ticker.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import weekday0

BAR_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("Date", T.DateType()),
    T.StructField("Open", T.DoubleType()),
    T.StructField("High", T.DoubleType()),
    T.StructField("Low", T.DoubleType()),
    T.StructField("Close", T.DoubleType()),
    T.StructField("Volume", T.DoubleType()),
])

GAUGE_SCHEMA = T.StructType([
    T.StructField("Date", T.DateType()),
    T.StructField("Close", T.DoubleType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def trading_day(date: Column) -> Column:
    """Saturdays and Sundays count to the Friday before them."""
    return F.date_sub(date, F.greatest(weekday0(date) - 4, F.lit(0)))


def line_order(*parts: tuple[str, int]) -> Column:
    """One decimal that orders like the (column, digits) parts in turn.

    A decimal is a fixed-width aggregation buffer, so that min_by and max_by
    over it stay hash aggregates, which a struct key would not. A value that
    needs more digits than its part has raises an error.
    """
    key, width = F.lit(0).cast("decimal(38,0)"), sum(digits for _, digits in parts)
    fits = F.lit(True)
    for column, digits in parts:
        width -= digits
        fits &= F.col(column).between(0, 10 ** digits - 1)
        key += F.col(column).cast(f"decimal({digits},0)") * F.lit(Decimal(10 ** width))
    too_wide = F.raise_error(F.lit("line_order: a key is negative or has too many digits")).cast("decimal(38,0)")
    return F.when(fits, key.cast("decimal(38,0)")).otherwise(too_wide)


def bars_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Six daily series from the driver's line items (FIXTURES.md mapping).

    ticker = returnflag || linestatus, Date = the trading day of the ship date,
    price = extendedprice / quantity; Open/Close = price of the first/last line
    of the day by order, line number, part and supplier; High/Low = max/min
    price; Volume = sum of quantity.  One partial and one final hash aggregate:
    each map task pre-aggregates to at most (#tickers x #dates) rows, so a
    ticker holding a third of all lines costs no more shuffle than any other.
    """
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    key = line_order(("l_orderkey", 13), ("l_linenumber", 2), ("l_partkey", 12), ("l_suppkey", 10))
    lines = lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("ticker"),
                            trading_day(F.to_date("l_shipdate")).alias("Date"), price.alias("price"), key.alias("k"), "l_quantity")
    return lines.groupBy("ticker", "Date").agg(
        F.min_by("price", "k").alias("Open"),
        F.max("price").alias("High"),
        F.min("price").alias("Low"),
        F.max_by("price", "k").alias("Close"),
        F.sum("l_quantity").alias("Volume"),
    )


def gauge_from_orders(orders: DataFrame) -> DataFrame:
    """Volatility-gauge stand-in on its own calendar: mean order total per order date."""
    return (
        orders.select(F.to_date("o_orderdate").alias("Date"), "o_totalprice")
        .groupBy("Date").agg(F.avg("o_totalprice").alias("Close"))
    )


def load_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_lineitem(table(spark, sf_dir, "lineitem"))


def load_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauge_from_orders(table(spark, sf_dir, "orders"))


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1 for files: scan a long OHLCV table with an explicit schema, drop rows
    without Close (B6).  A wide (one column group per ticker) input is unpivoted
    by ``unpivot_wide`` first."""
    reader = spark.read.schema(BAR_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", "true").option("dateFormat", "yyyy-MM-dd")
    return reader.format(fmt).load(path).dropna(subset=["Close"])


def unpivot_wide(wide: DataFrame, tickers: list[str], fields=("Open", "High", "Low", "Close", "Volume")) -> DataFrame:
    """Two-level wide frame (columns ``<field>_<ticker>``) to the long bar table."""
    stacked = F.explode(F.array(*[
        F.struct(F.lit(t).alias("ticker"), *[F.col(f"{f}_{t}").cast("double").alias(f) for f in fields])
        for t in tickers
    ])).alias("r")
    return (wide.select(F.col("Date").cast("date").alias("Date"), stacked)
            .select("r.ticker", "Date", *[f"r.{f}" for f in fields])
            .dropna(subset=["Close"]))


def with_ticker(df: DataFrame, ticker: str) -> DataFrame:
    """A2: add a literal ticker when the table has none (keeps an existing one)."""
    if "ticker" in df.columns:
        return df.withColumn("ticker", F.coalesce(F.col("ticker"), F.lit(ticker)))
    return df.withColumn("ticker", F.lit(ticker))


def read_tickers(spark: SparkSession, folder: str, tickers: Sequence[str], columns: T.StructType = BAR_SCHEMA) -> DataFrame:
    """A2: the files ``<folder>/<ticker>.parquet`` of the named tickers as one table, by one scan.

    Files may have different columns: schemas are merged, a column of
    ``columns`` that a file lacks is null in its rows, others are left out. The
    ticker of a row whose file has none is the file's name. Missing files raise
    a FileNotFoundError that names their tickers; the folder is listed once.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()
    missing = sorted(t for t in set(tickers) if f"{t}.parquet" not in there)
    if missing:
        raise FileNotFoundError(f"{folder} has no file of {', '.join(missing)}")
    found = spark.read.option("mergeSchema", "true").parquet(*[os.path.join(folder, f"{t}.parquet") for t in sorted(set(tickers))])
    of_file = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.parquet(?:/|$)", 1))
    have = {c.lower(): c for c in found.columns}
    out = []
    for f in columns:
        own = F.col(have[f.name.lower()]).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(own, of_file) if f.name == "ticker" else own).alias(f.name))
    return found.select(*out)


def cut_after_last_close(bars: DataFrame) -> DataFrame:
    """Drop rows later than the last non-null Close of their ticker."""
    last = F.max(F.when(F.col("Close").isNotNull(), F.col("Date"))).over(Window.partitionBy("ticker"))
    return (bars.withColumn("_last_close_date", last)
            .where(F.col("Date") <= F.col("_last_close_date")).drop("_last_close_date"))


def drop_missing_close(bars: DataFrame) -> DataFrame:
    """B6."""
    return bars.dropna(subset=["Close"])
