"""Helpers shared by the document operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.session import scratch_path

# Fixed value: the white space of the word and normalisation rules, [\x20\x09-\x0D].
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A side of a join is broadcast only after it was counted and found to hold no more rows than this.
BROADCAST_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage: what follows re-reads files that any executor can see.
    The folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"candlewick-llm/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a staged ``df`` of narrow rows only when its counted size is under the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_blocks(data: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, in lists made from about ``limit`` bytes each.

    bytes.split() cuts at exactly these six ASCII characters.
    """
    if len(data) <= limit:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text column of each has about ``limit`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def free_name(df: DataFrame, start: str) -> str:
    """A column name beginning with ``start`` that ``df`` does not have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while start.lower() in taken:
        start += "_"
    return start


def free_prefix(df: DataFrame, start: str) -> str:
    """``start``, lengthened until no column of ``df`` begins with it."""
    while any(c.lower().startswith(start.lower()) for c in df.columns):
        start += "_"
    return start


def without_rows(df: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` less the rows whose (id, text hash) is in the staged ``dropped(_k_id, _k_text)``.

    Null ids match null ids. The texts are shuffled only when the dropped keys
    are too many to broadcast.
    """
    return _against(df, small_side(dropped.distinct()), id_col, text_col, "left_anti")


def _against(df: DataFrame, side: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    key, text = free_name(df, "_k_id"), free_name(df, "_k_text")
    own, own_text = free_name(df, "_k_id2"), free_name(df, "_k_text2")
    left = df.withColumns({own: F.col(id_col), own_text: F.xxhash64(F.col(text_col))})
    right = side.select(F.col("_k_id").alias(key), F.col("_k_text").alias(text))
    return left.join(right, F.col(own).eqNullSafe(F.col(key)) & (F.col(own_text) == F.col(text)), how).drop(own, own_text)


def once(df: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with one of the rows of each (id, text hash) in the staged ``repeated(_k_id, _k_text)``."""
    if repeated.isEmpty():
        return df
    return without_rows(df, repeated, id_col, text_col).unionByName(
        _against(df, small_side(repeated), id_col, text_col, "left_semi").dropDuplicates([id_col, text_col]))
