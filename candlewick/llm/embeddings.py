"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import partitions, stage
from candlewick.llm.components import components

MIN_COSINE = 0.98
#: Tables, projections in each, and the width of a bucket. Vectors of length one at cosine 0.98 are 0.2 apart: a projection
#: puts both into one bucket of width 1 with probability 0.84, twelve do with 0.124, and one of 40 tables with 0.995;
#: at cosine 0.985 with 0.9994. Vectors at right angles share a bucket with probability 1e-7.
TABLES, PROJECTIONS, WIDTH, SEED = 40, 12, 1.0, 7
#: Members of a bucket that are compared at once; larger buckets are compared part against part.
PART = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def bucket_keys(vectors: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The 64-bit key of each table's bucket, for vectors of length one; ``salt`` tells apart what must never meet."""
    draw = np.random.default_rng(SEED + vectors.shape[1])
    lines = draw.standard_normal((vectors.shape[1], TABLES * PROJECTIONS))
    shift = draw.random(TABLES * PROJECTIONS) * WIDTH
    odd = draw.integers(0, 2**63, (TABLES, PROJECTIONS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    steps = np.floor((vectors @ lines + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(-1, TABLES, PROJECTIONS)
    h = (steps * odd).sum(axis=2, dtype=np.uint64) + salt.view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    h ^= np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            vectors = batch.column("embedding").to_pylist()
            salt = batch.column("salt").to_numpy()
            keys = np.empty((len(vectors), TABLES), np.int64)
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                same = np.flatnonzero(sizes == size)
                keys[same] = bucket_keys(unit(np.array([vectors[i] for i in same], float)), salt[same])
            flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, TABLES, dtype=np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "keys"])


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Links of a forest that spans the components of a symmetric matrix of links."""
    rest = near.any(axis=1)
    links = []
    for first in np.flatnonzero(rest):
        queue = [first] if rest[first] else []
        rest[first] = False
        while queue:
            x = queue.pop()
            found = np.flatnonzero(near[x] & rest)
            rest[found] = False
            links += [(int(x), int(y)) for y in found]
            queue += found.tolist()
    return links


def _compare(rows: dict[str, list], least: float) -> list[tuple[int, int | None, int]]:
    """Of one bucket, or two parts of one: (class, None, links it gains) and (class, class, 0) that span what is linked.

    A pair that an earlier table has put together is counted there.
    """
    out = []
    sizes = np.array([len(v) for v in rows["embedding"]])
    for size in np.unique(sizes):
        same = np.flatnonzero(sizes == size)
        if len(same) < 2:
            continue
        pick = lambda name, same=same: np.array([rows[name][i] for i in same])
        vectors, ids, weight, part, keys = unit(pick("embedding").astype(float)), pick("cid"), pick("n"), pick("part"), pick("keys")
        near = vectors @ vectors.T >= least
        np.fill_diagonal(near, False)
        if not near.any():
            continue
        out += [(int(ids[a]), int(ids[b]), 0) for a, b in _spanning(near)]
        a, b = np.nonzero(near)
        if rows["one"] != rows["two"]:
            across = part[a] != part[b]
            a, b = a[across], b[across]
        table = rows["table"]
        new = np.ones(len(a), bool)
        for earlier in range(table):
            new &= keys[a, earlier] != keys[b, earlier]
        gained = np.bincount(a[new], weight[b[new]], len(ids))
        out += [(int(ids[i]), None, int(gained[i])) for i in np.flatnonzero(gained)]
    return out


def _comparer(least: float):
    """Over rows sorted by group: the comparisons of each group."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("embedding", "cid", "n", "part", "keys")
        group, held = None, {f: [] for f in fields}

        def done() -> pa.RecordBatch:
            found = _compare(held, least) if len(held["cid"]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], names=["a", "b", "links"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                columns = {c: batch.column(c).to_pylist() for c in ("bucket", "one", "two", "table", *fields)}
                for i, key in enumerate(zip(columns["bucket"], columns["one"], columns["two"], columns["table"], strict=True)):
                    if key != group:
                        yield done()
                        group, held = key, {f: [] for f in fields} | {"one": key[1], "two": key[2], "table": key[3]}
                    for f in fields:
                        held[f].append(columns[f][i])
        yield done()

    return compare


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 least: float = MIN_COSINE) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept.

    Rows link when their labels are equal and their cosine is ``least`` or
    more. Equal vectors of a label are one class, which stands for its members
    in all that follows and is never expanded into pairs. Classes are hashed
    by TABLES groups of projections; members of a bucket are compared in
    double precision, large buckets part against part, so that no task holds
    more than two parts. A pair that meets in several tables is counted in the
    first. Only counts per class and links that span a bucket's components
    leave the tasks.

    Vectors that are null, empty, zero, or hold null or non-finite components,
    and rows without label or id, link with nothing: n_links 0, component_id
    their own id, kept (false for a null id). Vectors of different length
    never link. Repeated rows count as vectors of their own.
    """
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("embedding"), usable.alias("usable"))
    good = rows.filter("usable")
    classes = good.groupBy("label", "embedding").agg(F.min("id").alias("least"), F.count("*").alias("n")).select(
        F.monotonically_increasing_id().alias("cid"), "label", F.xxhash64("label").alias("salt"), "embedding", "least", "n")
    kinds = dict(classes.dtypes)
    hashed = stage(classes.mapInArrow(_hasher, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", keys array<long>"), "hashed")

    members = hashed.select("cid", F.posexplode("keys").alias("table", "bucket"))
    shared = members.groupBy("bucket", "table").agg(F.count("*").alias("in_bucket")).filter("in_bucket > 1")
    parts = F.ceil(F.col("in_bucket") / PART).cast("int")
    meeting = members.join(shared, ["bucket", "table"]).withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("cid", "table"), F.col("parts")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "bucket", "table", "cid", "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))
    held = meeting.join(hashed.select("cid", "embedding", "n", "keys"), "cid")
    group = ["bucket", "table", "one", "two"]
    found = stage(held.repartition(partitions(df.sparkSession), *group).sortWithinPartitions(*group)
                  .mapInArrow(_comparer(least), "a long, b long, links long"), "compared")

    gained = found.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("gained"))
    rooted = hashed.select("cid", "label", "embedding", "least", "n").join(gained, "cid", "left").join(
        components(found.filter("b is not null")).withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(
        "label", "embedding", (F.coalesce("gained", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.join(named, ["label", "embedding"]).select("id", "n_links", "component_id")
    alone = rows.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
