"""Best-fit packing after Martello-Toth dominance reduction, planned on the table of piece lengths."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candlewick.llm.common import slices, stage

CAPACITY = 2048
END_ID = 0


class ByteBpe:
    """The byte-level BPE of a ``tokenizers`` file, run by tiktoken: the ids are the same, in a quarter of the time.

    A byte-level file writes each byte as one printable character; ids of such
    a vocabulary are its merge ranks. A run of white space too long for
    tiktoken's pattern goes to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(byte[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
        # Fixed value: the word pattern of byte-level BPE.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(Tokenizer.from_file(self.path).encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than the capacity."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def _cutter(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = ByteBpe(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encoder.ids(text) if text else np.empty(0, np.uint32), end_id).astype("<u4")
                for i, (start, n) in enumerate(pieces(len(ids), capacity)):
                    rows.append((doc, i, start, n, zlib.crc32(ids[start:start + n].tobytes()), part, int(seen[n])))
                    seen[n] += 1
            kinds = [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"])
    return cut


def reduce_instance(count: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sets fixed for good, as (how many, [(length, times)]); ``count`` by length is left with the rest.

    From the longest piece w down, a set is fixed when it dominates every set
    that could hold w: w alone when nothing fits beside it; w with its exact
    complement; w with the longest piece that fits when no two others fit; and
    the same when no three others fit and that piece is at least as long as
    the longest pair that fits.
    """
    fixed: list[tuple[int, list[tuple[int, int]]]] = []

    def fix(w: int, k: int) -> None:
        m = int(count[w] // 2 if k == w else min(count[w], count[k]))
        count[w] -= m
        count[k] -= m
        fixed.append((m, [(w, 2)] if k == w else [(w, 1), (k, 1)]))

    for w in range(capacity, 0, -1):
        room = capacity - w
        while count[w]:
            count[w] -= 1  # what may stand beside one piece of length w
            small = np.flatnonzero(count[:room + 1])
            least = np.repeat(small[:3], np.minimum(count[small[:3]], 3))[:3] if len(small) else []
            longest = int(small[-1]) if len(small) else 0
            pair = 0
            if len(least) == 3 and least.sum() > room:
                other = np.zeros(room + 1, np.int64)  # the longest length up to each room
                other[small] = small
                other = np.maximum.accumulate(other)
                beside = other[room - small]
                beside = np.where((beside == small) & (count[small] < 2), np.where(small > 0, other[np.minimum(room - small, small - 1)], 0), beside)
                pair = int((small + beside)[beside > 0].max(initial=0))
            count[w] += 1
            if not len(small):
                fixed.append((int(count[w]), [(w, 1)]))
                count[w] = 0
            elif longest == room or len(least) < 2 or least[0] + least[1] > room:
                fix(w, longest)
            elif len(least) == 3 and least.sum() > room and longest >= pair:
                fix(w, longest)
            else:
                break
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on counts by length: sequences filled alike are one group."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {capacity: []}
    has = np.zeros(capacity + 1, bool)

    def put(room: int, m: int, held: list[tuple[int, int]]) -> None:
        if m:
            open_.setdefault(room, []).append((m, held))
            has[room] = True

    for s in np.flatnonzero(count)[::-1].tolist():
        n = int(count[s])
        while n:
            fit = np.flatnonzero(has[s:])
            room = s + int(fit[0]) if len(fit) else capacity
            m, held = open_[room].pop() if len(fit) else (-(-n // (capacity // s)), [])
            has[room] = bool(open_[room])
            each = room // s
            full = min(m, n // each)
            put(room - each * s, full, [*held, (s, each)])
            n -= full * each
            if full < m:
                if n:
                    put(room - n * s, 1, [*held, (s, n)])
                    full, n = full + 1, 0
                put(room, m - full, held)
    return [group for room in sorted(open_) for group in open_[room]]


def slots(count: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: those from the nth on, in order, into one sequence each at ``offset``."""
    left, rows, sequence = count.copy(), [], 0
    fixed = reduce_instance(left, capacity)
    used = np.zeros(capacity + 1, np.int64)
    for m, held in fixed + best_fit(left, capacity):
        offset = 0
        for size, times in held:
            for _ in range(times):
                rows.append((size, used[size], sequence, offset))
                used[size] += m
                offset += size
        sequence += m
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"size": table[:, 0], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def _placer(plan: dict[str, np.ndarray]):
    order = np.rec.fromarrays([plan["size"], plan["first"]], names="size,first")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            low, high = np.searchsorted(order["size"], size), np.searchsorted(order["size"], size, "right")
            while (high - low > 1).any():  # the last slot whose first rank is not above the piece's
                middle = (low + high) // 2
                up = order["first"][np.minimum(middle, len(order) - 1)] <= rank
                wide = high - low > 1
                low, high = np.where(wide & up, middle, low), np.where(wide & ~up, middle, high)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(plan["sequence"][low] + rank - plan["first"][low]), pa.array(plan["offset"][low])],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return place


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    The instance is the count of pieces by length, which has ``capacity`` rows
    at most however many documents there are: it alone comes to the driver.
    The reduction and the best fit work on those counts, so equal fillings are
    decided once. Pieces are numbered within their length by the task that cut
    them plus the counts of the tasks before; nothing is sorted or shuffled by
    length alone, and each piece finds its place in the plan by its number.

    A null or empty text is the one id ``end_id``. Repeated rows are packed
    each; an empty table gives an empty result. Null ids stay null.
    """
    kind = df.schema[id_col].dataType.simpleString()
    cut = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _cutter(tokenizer_path, capacity, end_id),
        f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")
    items = stage(cut, "pieces")
    per_task = items.groupBy("part", "length").count()
    count = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect():
        count[row["length"]] = row["n"]
    plan = slots(count, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    placed = items.join(before, ["part", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", "nth", "before").mapInArrow(
        _placer(plan), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


