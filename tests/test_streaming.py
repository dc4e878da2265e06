import tempfile

from pyspark.sql import functions as F

from candlewick.operators.indicators import BACKEND_PERIODS, raw_features
from candlewick.sources.bars import load_bars, load_gauge
from candlewick.sources.store import open_store, project_horizons
from candlewick.streaming.sync import start_sync


def test_streaming_sync_equals_full_recompute(spark, sf):
    work = tempfile.mkdtemp(prefix="cw-sync-")
    src, store_dir = f"{work}/src", f"{work}/store"
    bars, gauge = load_bars(spark, sf), load_gauge(spark, sf)
    cut = "1999-12-31"
    bars.where(F.col("Date") <= cut).write.mode("append").parquet(src)
    q = start_sync(spark, src, store_dir, gauge, checkpoint_location=f"{work}/ckpt")
    q.awaitTermination()
    bars.where(F.col("Date") > cut).write.mode("append").parquet(src)
    q = start_sync(spark, src, store_dir, gauge, checkpoint_location=f"{work}/ckpt")
    q.awaitTermination()
    got = open_store(spark, store_dir)["daily"]
    exp = project_horizons(raw_features(bars, gauge, BACKEND_PERIODS))["daily"]
    cols = exp.columns
    rounded = lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c)
                                     for c, t in df.select(*cols).dtypes])
    assert got.count() == exp.count()
    assert rounded(got).exceptAll(rounded(exp)).count() == 0
