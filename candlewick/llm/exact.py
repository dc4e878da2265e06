"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import SPACE_CHARS, once, small_side, stage, without_rows

PREFIX_CHARS = 64


def normalised(text_col: str):
    """The text without ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), SPACE_CHARS, "")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict | None = None) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, and the ``carry`` expressions over df's columns.

    1. Rows are counted by length of the normalised text and, among lengths
       that occur twice, by a hash of its first 64 characters: two aggregates
       of narrow keys.
    2. Only rows whose (length, prefix) group has another member get the full
       SHA-256. Groups are equal hashes; a hot group costs each map task one
       partial row. The groups are written and joined back by broadcast while
       they are few, else by a join whose hot keys AQE splits.
    3. The row with the most code points in the original text stays, then the
       least id (null ids last), then one by a hash of the original text.

    Null and empty texts are one group. Rows repeated with the same id and the
    same original text count as one document listed more than once: all of
    them are ``kept`` if they are the best. Ids are of any type that can be
    ordered. Other columns are not read.
    """
    carry = carry or {}
    norm = normalised(text_col)
    keyed = df.select(F.col(id_col).alias("_id"), F.length(norm).alias("_n"),
                      F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("_p"),
                      F.coalesce(F.length(text_col), F.lit(0)).alias("_chars"), F.xxhash64(text_col).alias("_t"), norm.alias("_norm"),
                      *[e.alias(f"_c_{k}") for k, e in carry.items()])
    narrow = ["_id", "_n", "_p", "_chars", "_t", *[f"_c_{k}" for k in carry]]

    prefixes = stage(keyed.groupBy("_n", "_p").agg(F.count("*").alias("_rows")), "prefixes")
    lengths = prefixes.groupBy("_n").agg(F.sum("_rows").alias("_all")).filter("_all > 1").select("_n")
    shared = stage(prefixes.filter("_rows > 1").join(lengths, "_n", "left_semi").select("_n", "_p"), "shared")

    marked = keyed.join(small_side(shared).withColumn("_again", F.lit(True)), ["_n", "_p"], "left")
    rows = stage(marked.select(*narrow, F.when(F.col("_again"), F.sha2("_norm", 256)).alias("_full")), "hashed")

    best = F.min(F.struct((-F.col("_chars")).alias("_less"), F.col("_id").isNull().alias("_no_id"), "_id", "_t"))
    groups = stage(rows.filter("_full is not null").groupBy("_full").agg(best.alias("_best"), F.count("*").alias("_size")), "groups")
    out = [F.col(f"_c_{k}").alias(k) for k in carry]
    many = rows.join(small_side(groups), "_full").select(
        F.col("_id").alias(id_col), F.col("_best._id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_best._id")) & (F.col("_chars") == -F.col("_best._less"))
         & (F.col("_t") == F.col("_best._t"))).alias("kept"), *out)
    one = rows.filter("_full is null").select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), *out)
    return many.union(one)


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its columns; a row listed more than once stays once."""
    found = stage(exact_groups(df, id_col, text_col, {"key": F.xxhash64(text_col)}), "groups")
    keys = found.select(F.col(id_col).alias("_k_id"), F.col("key").alias("_k_text"), "kept")
    repeated = stage(keys.filter("kept").groupBy("_k_id", "_k_text").count().filter("count > 1").drop("count"), "repeated")
    return once(without_rows(df, stage(keys.filter("not kept").drop("kept"), "dropped"), id_col, text_col), repeated, id_col, text_col)
