"""SimHash near-dedup: fingerprints of word shingles, linked through shared blocks of bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from candlewick.llm.common import once, partitions, small_side, stage, without_rows, word_blocks
from candlewick.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: More distinct fingerprints than this in one block are split by a second set of blocks.
LARGE_BLOCK = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text; zero without words."""
    if not text:
        return 0
    ones, total, last = np.zeros(64, np.int64), 0, []
    blocks = word_blocks(text.encode("utf-8", "surrogatepass").lower())
    for words in blocks:
        words = last + words
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        last = words[max(0, len(words) - shingle + 1):]
        total += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not total:
        if not last:
            return 0
        total, ones = 1, np.unpackbits(np.array([xxhash.xxh64_intdigest(b" ".join(last), SEED)], np.uint64).view(np.uint8), bitorder="little")
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprint_udf(shingle: int = SHINGLE):
    return F.pandas_udf(lambda texts: pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64"), LongType())


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` runs of the given bits, as even as can be."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(bits: list[int] | None = None, blocks: int = 6, max_bits: int = MAX_BITS) -> list[int]:
    """Every choice of blocks - max_bits blocks: fingerprints that differ in max_bits bits or fewer agree in one choice at least."""
    parts = _blocks(bits or list(range(64)), blocks)
    return [sum(c) for c in combinations(parts, blocks - max_bits)]


def _forest(f: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that span the components of distinct fingerprints ``f``: at most len(f) - 1."""
    if len(f) == 2:
        return [(int(f[0]), int(f[1]))] if int(np.bitwise_count(f[0] ^ f[1])) <= max_bits else []
    links, rest = [], f
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                links += [(int(x), int(y)) for y in rest[near]]
                queue += list(rest[near])
                rest = rest[~near]
    return links


def _linker(max_bits: int):
    """Over rows (key, fp) sorted by key: a spanning forest of the links inside each key."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def done(key, fp):
            links = []
            if len(key):
                cut = np.flatnonzero(np.diff(key)) + 1
                start, size = np.r_[0, cut], np.diff(np.r_[0, cut, len(key)])
                two = start[size == 2]
                near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
                links = list(zip(fp[near].view(np.int64).tolist(), fp[near + 1].view(np.int64).tolist(), strict=True))
                for s, n in zip(start[size > 2], size[size > 2], strict=True):
                    links += [(int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64)))
                              for a, b in _forest(np.unique(fp[s:s + n]), max_bits)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()),
                                               pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            key = np.r_[kept_key, batch.column(0).to_numpy()]
            fp = np.r_[kept_fp, batch.column(1).to_numpy().view(np.uint64)]
            if not len(key):
                continue
            whole = np.searchsorted(key, key[-1])  # the last key may go on in the next batch
            kept_key, kept_fp = key[whole:], fp[whole:]
            yield done(key[:whole], fp[:whole])
        yield done(kept_key, kept_fp)

    return link


def _in_blocks(fps: DataFrame, masks: list[int]) -> DataFrame:
    """A row (key, fp, mask) for each mask; the key hashes the mask's number and the masked bits.

    Two blocks whose keys collide are compared as one, which the distance check makes right.
    """
    each = F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask", "m")
    return fps.select("fp", each).select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("m"))).alias("key"), "fp", "mask")


def _run(rows: DataFrame, max_bits: int) -> DataFrame:
    return (rows.select("key", "fp").repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")
            .mapInArrow(_linker(max_bits), "a long, b long"))


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = 6) -> DataFrame:
    """Links (a, b) that connect all distinct ``fps(fp)`` within ``max_bits`` bits, verified.

    Pigeonhole: with 6 blocks, of which 3 bits can touch 3 at most, one of the
    20 choices of 3 blocks (about 32 bits) is equal. A choice shared by more
    than LARGE_BLOCK fingerprints is split once more, over its free bits, into
    20 choices of about 16 bits; such a group has no more than 2^17 different
    fingerprints whatever the input, so no group grows without bound and none
    is cut. Inside a group, links are found block against rest and only a
    spanning forest of them is written.
    """
    masks = block_masks(None, blocks, max_bits)
    rows = _in_blocks(fps, masks)
    large = stage(rows.groupBy("key", "mask").count().filter(F.col("count") > LARGE_BLOCK).drop("count"), "large")
    if large.isEmpty():
        return _run(rows, max_bits)
    side = small_side(large.select("key").distinct())
    links = _run(rows.join(side, "key", "left_anti"), max_bits)
    inner = F.array(*[F.array(*[F.lit(_signed(n)) for n in block_masks([b for b in range(64) if not m >> b & 1], blocks, max_bits)])
                      for m in masks])
    finer = (rows.join(side, "key", "left_semi")
             .select("fp", "key", F.posexplode(F.element_at(inner, F.col("mask") + 1)).alias("i", "m"))
             .select("fp", F.xxhash64("key", "i", F.col("fp").bitwiseAND(F.col("m"))).alias("key")))
    return links.union(_run(finer, max_bits))


def _rooted(df: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, carry: dict) -> DataFrame:
    """id, fp, the root fingerprint of its component, and the carried columns of each row."""
    rows = stage(df.select(F.col(id_col).alias("id"), fingerprint_udf(shingle)(text_col).alias("fp"),
                           *[e.alias(f"_c_{k}") for k, e in carry.items()]), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    found = components(fingerprint_links(classes.select("fp"), max_bits))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       max_bits: int = MAX_BITS, carry: dict | None = None) -> DataFrame:
    """One row per row of ``df``: id, fingerprint (16 hex digits), component_id, and the ``carry`` expressions.

    Copies meet in one class by their fingerprint before any link is sought;
    links are made between classes. component_id is the least id reachable.
    Texts that are null or have no word have fingerprint zero and link like
    any other. Null ids count for no least id; a component of null ids only
    has component_id null. Repeated rows are in one class.
    """
    carry = carry or {}
    return _rooted(df, id_col, text_col, shingle, max_bits, carry).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        *[F.col(f"_c_{k}").alias(k) for k in carry])


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df``, with its columns, less all but one of each component.

    The row with the least id stays, null ids last; of several with that id,
    the one with the least text hash, once.
    """
    rows = _rooted(df, id_col, text_col, shingle, max_bits, {"key": F.xxhash64(text_col)})
    rows = stage(rows.select("root", F.col("id").alias("_k_id"), F.col("_c_key").alias("_k_text")), "near")
    first = F.min(F.struct(F.col("_k_id").isNull().alias("no_id"), "_k_id", "_k_text")).alias("first")
    stays = rows.groupBy("root").agg(first)
    marked = rows.join(stays, "root").withColumn(
        "stays", F.col("_k_id").eqNullSafe(F.col("first._k_id")) & (F.col("_k_text") == F.col("first._k_text")))
    dropped = stage(marked.filter("not stays").select("_k_id", "_k_text"), "dropped")
    repeated = stage(marked.filter("stays").groupBy("_k_id", "_k_text").count().filter("count > 1").drop("count"), "repeated")
    left = without_rows(df, dropped, id_col, text_col)
    return once(left, repeated, id_col, text_col)
