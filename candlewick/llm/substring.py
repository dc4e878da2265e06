"""Substring dedup with fixed-block anchors.

The non-overlapping blocks of every document are the index; every rolling
window of block length probes it. With blocks of half a window (rounded up to
(window + 1) / 2), any repeated window holds a whole indexed block, so a
repeat always starts from a hit. Hits are extended word by word, as windows
that hold them, to the maximal stretches whose every window is found elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from candlewick.llm.common import partitions, word_blocks

WINDOW = 35
#: Segments (groups of documents hashed at one time) per shuffle partition; there are as many ranges of hash values as partitions.
#: A segment sends one message to each range, so both numbers stay low: messages are their product, like the blocks of any shuffle.
SEGMENTS = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_MESSAGE = "range int, segment int, kind int, n int, data binary"
_MESSAGE_ARROW = pa.schema([("range", pa.int32()), ("segment", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
ASKED, STARTS = 0, 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive values: a polynomial modulo 2^64, from prefix sums."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = np.cumprod(np.full(len(words), _STEP), dtype=np.uint64)
    inverse = np.cumprod(np.full(n, np.uint64(pow(int(_STEP), -1, 1 << 64))), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power, dtype=np.uint64)])
    return _mixed((sums[size:] - sums[:-size]) * inverse)


class Segment:
    """Documents of one segment in a fixed order, and the hashes of their words laid end to end."""

    def __init__(self, table: pa.Table, window: int):
        rows = table.to_pydict()
        order = sorted(range(table.num_rows), key=lambda i: (rows["key"][i], rows["id"][i] is None, 0 if rows["id"][i] is None else rows["id"][i]))
        self.ids = [rows["id"][i] for i in order]
        self.texts = [(rows["text"][i] or "").encode("utf-8", "surrogatepass") for i in order]
        parts = [[np.fromiter(map(xxhash.xxh64_intdigest, block), np.uint64, len(block)) for block in word_blocks(t)] for t in self.texts]
        self.lengths = np.array([sum(map(len, p)) for p in parts], np.int64)
        self.words = np.concatenate([np.empty(0, np.uint64), *(b for p in parts for b in p)])
        self.window, self.block = window, (window + 1) // 2
        self.first = np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)  # where each word's document starts
        self.left = np.repeat(np.cumsum(self.lengths), self.lengths) - np.arange(len(self.words))  # words to its end
        self.long = np.repeat(self.lengths >= window, self.lengths)

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the rolling blocks of documents that hold a window, and their hashes."""
        at = np.flatnonzero(self.long & (self.left >= self.block))
        return at, rolling(self.words, self.block)[at]

    def windows(self, hit_blocks: np.ndarray) -> np.ndarray:
        """Positions of the windows that hold a hit block."""
        hits = np.zeros(len(self.words) + 1, np.int64)
        hits[hit_blocks + 1] = 1
        up_to = np.cumsum(hits)
        at = np.flatnonzero(self.left >= self.window)
        return at[up_to[at + self.window - self.block + 1] > up_to[at]]

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rolling(self.words, self.window)[at], rolling(_mixed(self.words * _OTHER), self.window)[at]

    def covered(self, starts: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def _grouped(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (high, low), starts of equal runs in that order, and the run of each entry."""
    order = np.lexsort((low, high))
    h, w = high[order], low[order]
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])) if len(h) else np.empty(0, np.int64)
    run = np.empty(len(h), np.int64)
    run[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
    return order, starts, run


def _low(values: np.ndarray, size: int) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :size]


def _wide(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :data.shape[1]] = data
    return out.view(np.uint64).ravel()


class Hashes:
    """The distinct hashes of a segment in ascending order, to be sent by ranges of their first 64 bits.

    A hash goes as its last 48 bits, and 40 of a second one where given; flags
    tell whether it stands on an indexed block and whether it occurs twice.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray | None, indexed: np.ndarray, ranges: int):
        self.two = low is not None
        low = low if self.two else np.zeros_like(high)
        order, starts, self.run = _grouped(high, low)
        self.high, self.low = high[order][starts], low[order][starts]
        size = np.diff(np.append(starts, len(order)))
        self.twice = size > 1
        self.indexed = np.logical_or.reduceat(indexed[order], starts) if len(starts) else np.empty(0, bool)
        place = ((self.high >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        self.cut = np.searchsorted(place, np.arange(ranges + 1, dtype=np.uint64))

    def messages(self, segment: int) -> list[tuple]:
        out = []
        for r in np.flatnonzero(np.diff(self.cut)).tolist():
            part = slice(self.cut[r], self.cut[r + 1])
            body = [_low(self.high[part], 6)] + ([_low(self.low[part], 5)] if self.two else [])
            flags = [np.packbits(f[part]) for f in (self.indexed, self.twice)]
            out.append((r, segment, ASKED, int(self.cut[r + 1] - self.cut[r]), b"".join(x.tobytes() for x in body + flags)))
        return out

    def marked(self, replies: list[tuple[int, int, bytes]]) -> np.ndarray:
        """Which of the hashes given to the constructor were answered for, from (range, n, bits)."""
        good = np.zeros(len(self.high), bool)
        for r, n, bits in replies:
            good[self.cut[r]:self.cut[r + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        return good[self.run] if len(self.run) else np.empty(0, bool)


def _answer(two: bool):
    """Over the messages of one range: of each, which hashes occur twice or more in all and stand on an indexed block."""
    width = 11 if two else 6

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        passed = [i for i, kind in enumerate(rows["kind"]) if kind == STARTS]
        asked = [i for i, kind in enumerate(rows["kind"]) if kind == ASKED]
        out = [tuple(rows[c][i] for c in _MESSAGE_ARROW.names) for i in passed]
        bodies, indexed, times = [np.empty((0, width), np.uint8)], [np.empty(0, bool)], [np.empty(0, np.int64)]
        for i in asked:
            n, data = rows["n"][i], np.frombuffer(rows["data"][i], np.uint8)
            flags = data[n * width:].reshape(2, -1)
            bodies.append(np.concatenate([data[:n * 6].reshape(n, 6), data[n * 6:n * width].reshape(n, width - 6)], axis=1))
            indexed.append(np.unpackbits(flags[0], count=n).astype(bool))
            times.append(1 + np.unpackbits(flags[1], count=n).astype(np.int64))
        body = np.concatenate(bodies)
        if len(body):
            order, starts, run = _grouped(_wide(body[:, :6]), _wide(body[:, 6:]))
            good = (np.add.reduceat(np.concatenate(times)[order], starts) > 1) & np.logical_or.reduceat(np.concatenate(indexed)[order], starts)
            hit, at = good[run], 0
            for i in asked:
                n = rows["n"][i]
                if hit[at:at + n].any():
                    out.append((rows["range"][i], rows["segment"][i], ASKED, n, np.packbits(hit[at:at + n]).tobytes()))
                at += n
        return _table(out, _MESSAGE_ARROW)

    return answer


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _replies(table: pa.Table, kind: int) -> list[tuple[int, int, bytes]]:
    rows = table.to_pydict()
    return [(r, n, d) for r, k, n, d in zip(rows["range"], rows["kind"], rows["n"], rows["data"], strict=True) if k == kind]


def _probe(window: int, ranges: int):
    def probe(docs: pa.Table) -> pa.Table:
        seg = Segment(docs, window)
        at, h = seg.blocks()
        hashes = Hashes(h, None, (at - seg.first[at]) % seg.block == 0, ranges)
        return _table(hashes.messages(docs.column("segment")[0].as_py()), _MESSAGE_ARROW)
    return probe


def _extend(window: int, ranges: int):
    def extend(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _table([], _MESSAGE_ARROW)
        seg, number = Segment(docs, window), docs.column("segment")[0].as_py()
        at, h = seg.blocks()
        hits = at[Hashes(h, None, np.ones(len(h), bool), ranges).marked(_replies(answers, ASKED))]
        starts = seg.windows(hits)
        if not len(starts):
            return _table([], _MESSAGE_ARROW)
        hashes = Hashes(*seg.window_hashes(starts), np.ones(len(starts), bool), ranges)
        held = np.zeros(len(seg.words), bool)
        held[starts] = True
        note = (number % ranges, number, STARTS, len(held), np.packbits(held).tobytes())
        return _table([note, *hashes.messages(number)], _MESSAGE_ARROW)
    return extend


def _cut(window: int, ranges: int, schema: pa.Schema):
    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], schema)
        seg = Segment(docs, window)
        covered = np.zeros(len(seg.words), bool)
        for _, n, bits in _replies(answers, STARTS):
            starts = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n))
            hashes = Hashes(*seg.window_hashes(starts), np.ones(len(starts), bool), ranges)
            covered = seg.covered(starts[hashes.marked(_replies(answers, ASKED))])
        out, at = [], 0
        for doc, text, n in zip(seg.ids, seg.texts, seg.lengths.tolist(), strict=True):
            gone = covered[at:at + n]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
            kept, i = [], 0
            for block in word_blocks(text):
                mask = gone[i:i + len(block)]
                kept += [w for w, g in zip(block, mask.tolist(), strict=True) if not g] if mask.any() else block
                i += len(block)
            out.append((doc, n, int(gone.sum()), [{"start": a, "end": b} for a, b in edges.tolist()], b" ".join(kept).decode("utf-8", "surrogatepass")))
            at += n
        return _table(out, schema)
    return cut


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_removed, removed (spans of words), kept_text.

    Documents are dealt into segments by a hash of id and text, so that any
    task that hashes a segment again finds the same order. A segment sends
    each distinct block hash once, however often it occurs there, by ranges of
    hash values; a range answers with one bit per hash: found twice or more in
    all, on an indexed block. A passage that a third of the documents share
    thus costs each segment one entry. Windows around hits then go the same
    way with 88 bits of two hashes besides their range, and what is answered
    for is covered. Texts are shuffled once and read by three steps.

    Null and empty texts have no words; documents shorter than a window lose
    none. Repeated rows are documents of their own, so each repeats the other.
    An empty table gives no row. Other columns are not read.
    """
    n = partitions(df.sparkSession)
    ranges, segments = n, n * SEGMENTS
    kind = df.schema[id_col].dataType.simpleString()
    key = F.xxhash64(id_col, text_col)
    docs = df.select(F.pmod(key, F.lit(segments)).cast("int").alias("segment"), key.alias("key"), F.col(id_col).alias("id"),
                     F.col(text_col).alias("text")).repartition(n, "segment")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("id", to_arrow_type(df.schema[id_col].dataType)), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", spans), ("kept_text", pa.string())])

    probes = docs.groupBy("segment").applyInArrow(_probe(window, ranges), _MESSAGE)
    hits = probes.groupBy("range").applyInArrow(_answer(False), _MESSAGE)
    windows = docs.groupBy("segment").cogroup(hits.groupBy("segment")).applyInArrow(_extend(window, ranges), _MESSAGE)
    repeats = windows.groupBy("range").applyInArrow(_answer(True), _MESSAGE)
    out = docs.groupBy("segment").cogroup(repeats.groupBy("segment")).applyInArrow(
        _cut(window, ranges, schema), f"id {kind}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")
    return out.withColumnRenamed("id", id_col)
