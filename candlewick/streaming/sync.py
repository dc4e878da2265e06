"""D7 as a Structured Streaming job: incremental indicator sync.

New daily bars land as parquet files in ``source_dir``.  Each micro-batch
(``foreachBatch``, trigger ``availableNow`` by default):

1. keeps the latest row of every (ticker, Date): by the file's modification
   time, then its path, then the row's place in it;
2. advances the state of the touched tickers from the row before their first
   bar in the batch (``store.apply_bars``): new and corrected bars alike, and
   the bars kept after them; older bars are not read;
3. commits state and the three horizon tables at once, with the batch's number:
   a replayed batch, or one that was stopped midway, leaves no trace.

The stream's checkpoint lives in the shared checkpoint folder, so a restarted
job resumes after the last committed epoch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indicators import BACKEND_PERIODS, daily_frame
from ..session import scratch_path, written
from ..sources.bars import BAR_SCHEMA
from ..sources.store import KEYS, apply_bars, latest_rows
from ..sources.versions import Version

#: Where a streamed row comes from, in the order in which later rows win.
ARRIVAL = ("_modified", "_path", "_place")


def sync_batch(batch: DataFrame, store_dir: str, gauge: DataFrame | None, periods: Sequence[int] = BACKEND_PERIODS,
               number: tuple[str, int] | None = None, default_start: str | None = None) -> Version:
    """One micro-batch of the sync (also usable as a plain batch step)."""
    order = [c for c in ARRIVAL if c in batch.columns]
    bars = written(latest_rows(batch.select(*BAR_SCHEMA.fieldNames(), *order), KEYS, order), "batch")
    return apply_bars(batch.sparkSession, store_dir, daily_frame(bars, gauge), periods, number, default_start)


def start_sync(spark: SparkSession, source_dir: str, store_dir: str, gauge: DataFrame | None = None,
               periods: Sequence[int] = BACKEND_PERIODS, available_now: bool = True,
               checkpoint_location: str | None = None, stream: str = "bars", default_start: str | None = None):
    """Start the streaming sync; returns the StreamingQuery.

    ``stream`` names the source in the store's manifest: two streams into one
    store need two names.
    """
    meta = [F.col(f"_metadata.{m}").alias(c) for m, c in zip(("file_modification_time", "file_path", "row_index"), ARRIVAL)]
    bars = spark.readStream.schema(BAR_SCHEMA).parquet(source_dir).select("*", *meta).dropna(subset=["Close"])
    writer = (bars.writeStream
              .foreachBatch(lambda df, epoch: sync_batch(df, store_dir, gauge, periods, (stream, epoch), default_start))
              .option("checkpointLocation", checkpoint_location or scratch_path(spark, "sync-stream")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
