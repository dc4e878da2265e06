"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``VNODES`` points of a ring of 2^64 places. A row belongs to
the first point at or after its own place, clockwise. No shard takes more than
(1 + SLACK) times the mean of bytes: what would overflow a full shard goes on
clockwise to the next shard that has room.

Rows arrive in a fixed order: those heavier than HEAVY of a shard's mean one by
one, heaviest first; then all others along the ring. The heavy ones number at
most shards / HEAVY whatever the table's size, so the driver places them
exactly. Of the others it needs only the bytes on each arc between two points
(shards x VNODES sums): an arc goes whole to one shard, but for the arcs in
which a shard gets full. A shard gets full once, so at most that many arcs are
cut, at a place found from sums over PIECES parts of the arc. The result is
again a ring, of arcs and parts of arcs, which tasks look up row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.common import small_side, stage

SHARDS, VNODES, SEED = 40, 128, 42
#: No shard holds more than 1 + SLACK times the mean, besides the row that closes it; the emptiest lacks (shards - 1) * SLACK at most.
SLACK = 0.0002
#: Share of a shard's mean from which on a row is placed by itself: at most shards / HEAVY rows are.
HEAVY = 0.001
PIECES = 1024
#: Rows that are numbered by one sort, on average.
SLOT_ROWS = 20_000
ROW_BYTES = 16


class Ring:
    """Places of the virtual nodes in ascending order and the shard of each.

    A shard's places depend on its number alone, so a ring with one more shard
    has all the places of the smaller one.
    """

    def __init__(self, shards: int, vnodes: int = VNODES, seed: int = SEED):
        points = sorted((xxhash.xxh64_intdigest(f"{s}:{v}", seed), s) for s in range(shards) for v in range(vnodes))
        self.places = np.array([p for p, _ in points], np.uint64)
        self.owner = np.array([s for _, s in points], np.int32)

    def arc(self, place: np.ndarray) -> np.ndarray:
        """Number of the first point at or after a place; the arc that ends there."""
        at = np.searchsorted(self.places, place)
        return np.where(at == len(self.places), 0, at)

    def start(self, arc: int) -> int:
        """Place of the point before an arc (the arc across zero starts below it)."""
        return int(self.places[arc - 1]) if arc else int(self.places[-1]) - (1 << 64)

    def clockwise(self, arc: int, is_open: np.ndarray) -> int:
        """The shard of the first point from an arc's end on whose shard is open; -1 if none is."""
        later = is_open[self.owner[arc:]]
        if later.any():
            return int(self.owner[arc + int(later.argmax())])
        earlier = is_open[self.owner[:arc]]
        return int(self.owner[int(earlier.argmax())]) if earlier.any() else -1


def place_heavy(ring: Ring, places: np.ndarray, sizes: np.ndarray, limit: float, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of every heavy row, heaviest first, and the loads they make.

    A row that no shard has room for goes to the least loaded one.
    """
    loads, out = np.zeros(shards), np.empty(len(places), np.int32)
    arcs = ring.arc(places)
    for i in np.lexsort((places, -sizes)).tolist():
        shard = ring.clockwise(int(arcs[i]), loads + sizes[i] <= limit)
        out[i] = shard if shard >= 0 else int(loads.argmin())
        loads[out[i]] += sizes[i]
    return out, loads


def fair_share(sizes: np.ndarray, total: float, shards: int) -> float:
    """Mean load of the shards that are left when each row above that mean has a shard to itself."""
    for size in -np.sort(-sizes):
        if shards == 1 or size <= total / shards:
            break
        total, shards = total - size, shards - 1
    return total / shards


def water_level(loads: np.ndarray, more: float) -> float:
    """The least level to which ``more`` can be filled up on top of the loads."""
    ordered = np.sort(loads)
    room = ordered * np.arange(1, len(ordered) + 1) - np.cumsum(ordered)  # up to each load's own level
    n = int(np.searchsorted(room, more, "right"))
    return float(ordered[n - 1] + (more - room[n - 1]) / n)


def place_arcs(ring: Ring, arc_bytes: np.ndarray, loads: np.ndarray, limit: float) -> list[list[tuple[float, int]]]:
    """For every arc its shards as (bytes from the arc's start up to which, shard), along the ring."""
    loads, is_open = loads.copy(), loads < limit
    out = []
    for arc, left in enumerate(arc_bytes.tolist()):
        done, parts = 0.0, []
        while True:
            shard = ring.clockwise(arc, is_open)
            room = limit - loads[shard]
            if shard < 0 or left <= room or is_open.sum() == 1:
                shard = shard if shard >= 0 else int(loads.argmin())
                loads[shard] += left
                parts.append((done + left, shard))
                break
            loads[shard] = limit
            is_open[shard] = False
            done, left = done + room, left - room
            parts.append((done, shard))
        out.append(parts)
    return out


def _placed(df: DataFrame, id_col: str, size, carry: dict) -> DataFrame:
    """(row, id, size, carried columns, place) staged: a row's place is a hash of its id.

    Ids that occur again would pile up in one place: their rows are told apart by a number that is written with them.
    """
    columns = {"_s_id": F.col(id_col), "_s_size": size, "_s_row": F.monotonically_increasing_id(), **carry}
    rows = stage(df.select(*[c.alias(k) for k, c in columns.items()]), "rows")
    key = F.xxhash64("_s_id")
    again = stage(rows.groupBy(key.alias("_s_key")).count().filter("count > 1").select("_s_key", F.lit(True).alias("_s_again")), "again")
    place = F.xxhash64("_s_key", F.when(F.col("_s_again"), F.col("_s_row")))
    return rows.withColumn("_s_key", key).join(small_side(again), "_s_key", "left").withColumn("_s_place", place).drop("_s_key", "_s_again")


def _unsigned(place: pd.Series) -> np.ndarray:
    return place.to_numpy(np.int64).view(np.uint64)


def _inside(ring: Ring, arc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How far a place is from its arc's start."""
    return place - ring.places[arc - 1]  # modulo 2^64, so the arc across zero needs no case


def shard_rows(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", carry: dict | None = None,
               vnodes: int = VNODES, slack: float = SLACK, seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: id, size, shard, slot and the ``carry`` expressions over df's columns.

    size is the text's UTF-8 bytes plus 16, shard 0 to shards - 1, slot the
    place in the shard, gapless from 0. Sizes are near equal: no shard holds
    more than (1 + slack) times the mean and one row. Rows above the mean have
    a shard each, and the mean is that of the other rows and shards.

    Null and empty texts weigh 16 bytes. Null ids are ids like any other. Rows
    whose id occurs again are spread over the ring; which of the rows equal in
    all columns goes where may change with the input's partitions, all else is
    fixed by ids and sizes. An empty table gives no row. Columns of ``df``
    other than the two and those in ``carry`` are not read and may have any
    name.

    Three narrow shuffles (ids that occur again, arc sums, slots); texts are
    read once and moved only if they are carried.
    """
    carry = carry or {}
    held = {f"_c_{k}": c for k, c in carry.items()}
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(ROW_BYTES)).cast("long")
    rows = stage(_placed(df, id_col, size, held), "placed")
    ring = Ring(shards, vnodes, seed)
    n, total = rows.agg(F.count("*"), F.sum("_s_size")).first()
    mean = (total or 0) / shards
    edges, owners, heavy = _cut_ring(rows, ring, mean, shards, slack)

    @F.pandas_udf("int")
    def light_shard(place: pd.Series) -> pd.Series:
        places = _unsigned(place)
        at = np.searchsorted(edges, places)
        return pd.Series(owners[np.where(at == len(edges), 0, at)])

    alone = rows.sparkSession.createDataFrame(heavy, "_s_place long, _s_own int")  # at most shards / HEAVY rows
    dealt = rows.join(F.broadcast(alone), "_s_place", "left").withColumn("_s_shard", F.coalesce("_s_own", light_shard("_s_place")))
    buckets = max(1, (n or 0) // (shards * SLOT_ROWS))
    spot = F.shiftrightunsigned("_s_place", 11).cast("double") / F.lit(float(1 << 53))
    dealt = stage(dealt.withColumn("_s_bucket", F.floor(spot * F.lit(buckets))), "dealt")
    sums = dealt.groupBy("_s_shard", "_s_bucket").agg(F.count("*").alias("_s_n"))
    up_to = F.sum("_s_n").over(Window.partitionBy("_s_shard").orderBy("_s_bucket"))
    first = stage(sums.withColumn("_s_first", up_to - F.col("_s_n")).drop("_s_n"), "first-slots")
    order = Window.partitionBy("_s_shard", "_s_bucket").orderBy("_s_place", "_s_row")
    slot = F.col("_s_first") + F.row_number().over(order) - 1
    return dealt.join(small_side(first), ["_s_shard", "_s_bucket"]).select(
        F.col("_s_id").alias(id_col), F.col("_s_size").alias("size"), F.col("_s_shard").alias("shard"), slot.cast("long").alias("slot"),
        *[F.col(f"_c_{k}").alias(k) for k in carry])


def _cut_ring(rows: DataFrame, ring: Ring, mean: float, shards: int, slack: float) -> tuple[np.ndarray, np.ndarray, list]:
    """Ends of arcs and parts of arcs in ascending order, the shard of each, and (place, shard) of the heavy rows."""
    alone = rows.filter(F.col("_s_size") > HEAVY * mean).select("_s_place", "_s_size").toPandas()
    sizes = alone["_s_size"].to_numpy(np.float64)
    own, loads = place_heavy(ring, _unsigned(alone["_s_place"]), sizes, (1 + slack) * fair_share(sizes, mean * shards, shards), shards)
    light = rows.filter(F.col("_s_size") <= HEAVY * mean).select("_s_place", "_s_size")

    @F.pandas_udf("int")
    def arc_of(place: pd.Series) -> pd.Series:
        return pd.Series(ring.arc(_unsigned(place)).astype(np.int32))

    arc_bytes = np.zeros(len(ring.places))
    for arc, size in light.groupBy(arc_of("_s_place").alias("arc")).agg(F.sum("_s_size")).collect():
        arc_bytes[arc] = size
    rest = float(arc_bytes.sum())
    parts = place_arcs(ring, arc_bytes, loads, water_level(loads, rest * (1 + slack)))
    cut = [a for a, p in enumerate(parts) if len(p) > 1]
    widths = np.diff(np.concatenate([ring.places[-1:], ring.places])).astype(np.uint64)  # modulo 2^64

    @F.pandas_udf("int")
    def piece_of(place: pd.Series) -> pd.Series:
        places = _unsigned(place)
        arc = ring.arc(places)
        inside = _inside(ring, arc, places).astype(np.float64) / widths[arc].astype(np.float64)
        return pd.Series(np.minimum(inside * PIECES, PIECES - 1).astype(np.int32))

    sums = np.zeros((len(cut), PIECES))
    if cut:
        number = {a: i for i, a in enumerate(cut)}
        inside = light.withColumn("arc", arc_of("_s_place")).filter(F.col("arc").isin(cut))
        for arc, piece, size in inside.groupBy("arc", piece_of("_s_place").alias("piece")).agg(F.sum("_s_size")).collect():
            sums[number[arc], piece] = size
    edges, owners = [], []
    for arc, shares in enumerate(parts):
        if len(shares) > 1:
            up_to = np.cumsum(sums[number[arc]])
            start, width = ring.start(arc), int(widths[arc])
            for upto, shard in shares[:-1]:
                # A piece belongs to the shard up to whose end its own start lies.
                edges.append((start + width * int(np.searchsorted(up_to, upto) + 1) // PIECES - 1) % (1 << 64))
                owners.append(shard)
        edges.append(int(ring.places[arc]))
        owners.append(shares[-1][1])
    order = np.lexsort((np.arange(len(edges)), np.array(edges, np.uint64)))
    heavy = list(zip(alone["_s_place"].tolist(), own.tolist()))
    return np.array(edges, np.uint64)[order], np.array(owners, np.int32)[order], heavy


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """``df`` as Parquet folders ``shard=0`` ... under ``path``, with its columns and ``slot``.

    A shard is written by as many tasks as it has ranges of slots, each file in
    slot order. Columns of ``df`` named shard, slot or size are replaced.
    """
    kept: Sequence[str] = [c for c in df.columns if c not in ("shard", "slot", "size", id_col)]
    out = shard_rows(df, shards, id_col, text_col, {c: F.col(c) for c in kept}, **options)
    ranged = out.withColumn("_s_range", F.floor(F.col("slot") / SLOT_ROWS))
    ranged.repartition("shard", "_s_range").sortWithinPartitions("shard", "slot").drop("_s_range").write.partitionBy("shard").parquet(path)
