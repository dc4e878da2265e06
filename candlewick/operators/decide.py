"""Band -> decision operators (D2-D12) and the serving contract check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, pct_change
from .evaluate import PRED_CLASSES, predicted_recommendation

CONFIDENCE_REF_WIDTH = 10.0   # band width (percent points) mapped to confidence 0

# Display names of the driver-derived tickers (return flag and
# line status of the line items they are built from).
FLAG_WORDS = {"A": "Accepted", "N": "None", "R": "Returned"}
STATUS_WORDS = {"F": "Filled", "O": "Open"}


def band(q10: Column, q50: Column, q90: Column) -> list[Column]:
    """D2 + D3: ordered edges and confidence clip(1 - width/10, 0, 1)."""
    low, high = F.least(q10, q90), F.greatest(q10, q90)
    conf = clip(1.0 - (high - low) / CONFIDENCE_REF_WIDTH, 0.0, 1.0)
    return [low.alias("low"), q50.alias("mid"), high.alias("high"), conf.alias("confidence")]


def recommendation_label(low: Column, high: Column) -> Column:
    """K7 as text."""
    code = predicted_recommendation(low, high)
    return F.element_at(F.array(*[F.lit(x) for x in PRED_CLASSES]), code + 1)


def predict_band(scored: DataFrame, keep: Sequence[str]) -> DataFrame:
    """D1 tail: quantile predictions -> band, confidence and recommendation."""
    b = scored.select(*keep, *band(F.col("q10"), F.col("q50"), F.col("q90")))
    return b.withColumn("recommendation", recommendation_label(F.col("low"), F.col("high")))


def contract_check(pred: DataFrame, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Violation counts of the prediction contract."""
    missing = F.col("low").isNull() | F.col("mid").isNull() | F.col("high").isNull() | F.col("confidence").isNull()
    return pred.groupBy(*by).agg(
        F.count("*").cast("bigint").alias("n_predictions"),
        F.count_if(F.col("low") > F.col("high")).cast("bigint").alias("low_above_high"),
        F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).cast("bigint").alias("confidence_out_of_range"),
        F.count_if(missing).cast("bigint").alias("missing_keys"),
    )


def market_snapshot(bars: DataFrame) -> DataFrame:
    """Latest close per ticker, change vs the previous close, direction."""
    w = Window.partitionBy("ticker").orderBy("Date")
    newest = Window.partitionBy("ticker").orderBy(F.col("Date").desc())
    pct = pct_change(F.col("Close"), F.col("prev_close"))
    return (bars.select("ticker", "Date", "Close", F.lag("Close").over(w).alias("prev_close"))
            .withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1)
            .select("ticker", "Date", F.col("Close").alias("last_close"), "prev_close",
                    pct.alias("pct_change"),
                    F.when(pct > 0, "up").when(pct < 0, "down").otherwise("flat").alias("direction")))


def profit_estimate(pred: DataFrame, amount: float = 1000.0, keep: Sequence[str] = ()) -> DataFrame:
    """Money range of an amount invested over the band."""
    return pred.select(*keep, F.lit(float(amount)).alias("amount"),
                       (amount * F.col("low") / 100.0).alias("profit_low"),
                       (amount * F.col("high") / 100.0).alias("profit_high"))


def ticker_name(ticker: Column) -> Column:
    """Display name from the two letters of a driver ticker (literal maps, no join)."""
    flag = F.create_map(*[x for k, v in FLAG_WORDS.items() for x in (F.lit(k), F.lit(v))])
    status = F.create_map(*[x for k, v in STATUS_WORDS.items() for x in (F.lit(k), F.lit(v))])
    return F.concat_ws(" / ", F.try_element_at(flag, F.substring(ticker, 1, 1)),
                       F.try_element_at(status, F.substring(ticker, 2, 1)))


def _pct_text(x: Column) -> Column:
    return F.round(x, 2).cast("decimal(18,2)").cast("string")


def forecast_card(pred: DataFrame, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Newest prediction per ticker as a card row."""
    newest = Window.partitionBy(*by, "ticker").orderBy(F.col("Date").desc())
    last = pred.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1).drop("_rn")
    return last.select(
        *by, F.col("ticker").alias("symbol"), ticker_name(F.col("ticker")).alias("name"), "Date",
        "recommendation",
        F.concat(_pct_text(F.col("low")), F.lit("% to "), _pct_text(F.col("high")), F.lit("%")).alias("range_text"),
        F.concat(F.round(F.col("confidence") * 100.0, 0).cast("bigint").cast("string"), F.lit("%")).alias("confidence_text"),
        "confidence")


def market_summary(cards: DataFrame, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Majority recommendation (ties -> alphabetical), mean confidence, last update."""
    counts = cards.groupBy(*by, "recommendation").agg(F.count("*").alias("_n"))
    top = Window.partitionBy(*by).orderBy(F.col("_n").desc(), F.col("recommendation"))
    sentiment = (counts.withColumn("_rk", F.row_number().over(top)).where(F.col("_rk") == 1)
                 .select(*by, F.col("recommendation").alias("sentiment")))
    stats = cards.groupBy(*by).agg(F.avg("confidence").alias("mean_confidence"),
                                   F.max("Date").alias("last_update"),
                                   F.count("*").cast("bigint").alias("n_cards"))
    return stats.join(sentiment, list(by), "inner")
