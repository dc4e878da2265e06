"""Ranked lexical search, accumulator-limited and term at a time.

Documents are indexed in blocks: an Arrow task turns about ``BLOCK_BYTES`` of
text into the posting lists of the query terms. A block then takes the terms of
an item rarest first. A document gets an accumulator when a term finds it, until
the terms that remain cannot lift a document without one to the kth partial
score; from then on only documents that have an accumulator are updated, exactly.

The kth partial score is one of all blocks, not of the block alone: a first
round over the staged index scores every item by its rarest terms only and
takes the kth best of the whole table. That is a bound from below on the final
kth score, so blocks stop early and return only what can still be ranked.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from candlewick.llm.common import slices, small_side, stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 16_384
#: Terms of the items that are searched in one pass over the documents.
PASS_TERMS = 100_000
#: The first round scores an item by its rarest terms, until they have this many postings for each row asked for.
SEED_POSTINGS = 20
_TERMS = re.compile(TERM)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_INDEX = "ids binary, lengths binary, terms binary, ends binary, docs binary, freqs binary, n_docs long, n_terms long"


def terms(text: str | None) -> list[str]:
    return _TERMS.findall(text.translate(_LOWER)) if text else []


def idf(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _index_blocks(vocabulary: dict[str, int], id_type: pa.DataType):
    """Arrow function: documents to one row per block, with the postings of the terms in ``vocabulary``."""
    def block(ids: list, texts: list) -> dict:
        lengths, found = np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            words = terms(text)
            lengths[i] = len(words)
            for word, n in Counter(words).items():
                at = vocabulary.get(word)
                if at is not None:
                    found.append((at, i, n))
        postings = np.array(found, np.int64).reshape(-1, 3)
        postings = postings[np.lexsort((postings[:, 1], postings[:, 0]))]
        own, starts = np.unique(postings[:, 0], return_index=True)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", id_type)])) as out:
            out.write_table(pa.table({"id": pa.array(ids, id_type)}))
        return {"ids": sink.getvalue().to_pybytes(), "lengths": lengths.tobytes(), "terms": own.astype(np.int32).tobytes(),
                "ends": np.append(starts[1:], len(postings)).astype(np.int64).tobytes() if len(own) else b"",
                "docs": postings[:, 1].astype(np.int32).tobytes(), "freqs": postings[:, 2].astype(np.int64).tobytes(),
                "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.binary()) for c in ("ids", "lengths", "terms", "ends", "docs", "freqs")] + [("n_docs", pa.int64()), ("n_terms", pa.int64())])
        ids, texts, size = [], [], 0
        for batch in slices(batches, "text", BLOCK_BYTES):
            if ids and (size + batch.nbytes > BLOCK_BYTES or len(ids) + batch.num_rows > BLOCK_ROWS):
                yield pa.RecordBatch.from_pylist([block(ids, texts)], schema)
                ids, texts, size = [], [], 0
            ids += batch.column("id").to_pylist()
            texts += batch.column("text").to_pylist()
            size += batch.nbytes
        if ids:
            yield pa.RecordBatch.from_pylist([block(ids, texts)], schema)
    return run


class Block:
    """The posting lists of one block, and each posting's part of a score for one occurrence in an item."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = pa.ipc.open_stream(row["ids"]).read_all().column("id")
        lengths = np.frombuffer(row["lengths"], np.int64)
        docs, freqs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["freqs"], np.int64)
        ends = np.frombuffer(row["ends"], np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        own = np.frombuffer(row["terms"], np.int32)
        norm = 12 * (75 + 25 * lengths * n_docs // n_terms)
        gains = np.repeat(weights[own], ends - starts) * (1_000_000_000 * freqs // (1000 * freqs + norm[docs]))
        tops = np.maximum.reduceat(gains, starts) if len(own) else gains
        self.size = len(lengths)
        self.lists = {int(t): (docs[s:e], gains[s:e], int(top)) for t, s, e, top in zip(own, starts, ends, tops)}

    def partial(self, item: list[tuple[int, int]]) -> np.ndarray:
        """Scores by the given (term, occurrences) alone, of every document of the block."""
        scores = np.zeros(self.size, np.int64)
        for term, often in item:
            docs, gains, _ = self.lists.get(term, ((), (), 0))
            if len(docs):
                scores[docs] += often * gains
        return scores

    def best(self, item: list[tuple[int, int]], floor: int, k: int) -> np.ndarray:
        """Scores of the documents that can be among the k best, zero for all others.

        ``item`` has its terms rarest first; ``floor`` is a score that the kth
        best document of the whole table has at least.
        """
        here = [(often, *self.lists[term]) for term, often in item if term in self.lists]
        left = np.append(np.cumsum([often * top for often, _, _, top in here][::-1])[::-1], 0)
        scores, kept = np.zeros(self.size, np.int64), np.zeros(self.size, bool)
        creating = True
        for i, (often, docs, gains, _) in enumerate(here):
            # A document without an accumulator reaches left[i] at most; equal scores are told apart by id, so it must stay below.
            if creating and i and left[i] >= floor and scores.max() > left[i] and kept.sum() >= k:
                floor = max(floor, int(np.partition(scores, self.size - k)[self.size - k]))
            creating = creating and left[i] >= floor
            if creating:
                scores[docs] += often * gains
                kept[docs] = True
            elif not kept.any():
                break
            else:
                own = kept[docs]
                scores[docs[own]] += often * gains[own]
        scores[scores < floor] = 0
        return scores


def _seed(items: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Arrow function: blocks to (item, partial score) of their k best by the given terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, weights, n_docs, n_terms)
                number, score = [], []
                for i, item in enumerate(items):
                    found = block.partial(item)
                    found = np.sort(found[found > 0])[-k:]
                    number += [i] * len(found)
                    score += found.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(score, pa.int64())], ["item", "score"])
    return run


def _search(items: list[list[tuple[int, int]]], floors: list[int], weights: np.ndarray, n_docs: int, n_terms: int, k: int, id_type: pa.DataType):
    """Arrow function: blocks to (item, id, score) of at most k rows an item, equal scores by ascending id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, weights, n_docs, n_terms)
                number, at, score = [], [], []
                for i, item in enumerate(items):
                    scores = block.best(item, floors[i], k)
                    found = np.flatnonzero(scores)
                    if len(found) > k:
                        found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k]]
                    if len(found) > k:
                        tied = pa.table({"score": scores[found], "id": block.ids.take(found)})
                        order = pa.compute.sort_indices(tied, [("score", "descending"), ("id", "ascending")])
                        found = found[order.to_numpy()[:k]]
                    number += [i] * len(found)
                    at += found.tolist()
                    score += scores[found].tolist()
                ids = block.ids.take(pa.array(at, pa.int64())).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number, pa.int32()), ids if isinstance(ids, pa.Array) else pa.array([], id_type), pa.array(score, pa.int64())],
                    ["item", "id", "score"])
    return run


def _passes(queries: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """The distinct items dealt to passes of about PASS_TERMS term occurrences each."""
    items = stage(queries.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).distinct(), "items")
    total = items.agg(F.sum(F.regexp_count("text", F.lit(TERM)))).first()[0] or 0
    n = -(-total // PASS_TERMS)
    return [items] if n < 2 else [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def rank(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of ``docs`` for every item of ``queries``.

    The score sums, over an item's terms with repeats, the integer product of a
    term's weight and its saturated, length-normalised frequency in the
    document (weights and norms as in ``idf`` and ``Block``). Only scores above
    0 are ranked, equal ones by ascending id, null ids last.

    Null and empty texts have no terms: such documents are not counted, such
    items get no row. Items repeated with the same id and text are one item;
    rows of ``docs`` repeated are ranked each. An empty table on either side
    gives no row. Other columns are not read. A very long document is a block
    of its own.

    Items go in passes of about PASS_TERMS terms, whose dictionary travels with
    the tasks; each pass reads the documents once. From a block come at most k
    rows an item, and no more than k of them per task reach the final ordering.
    """
    id_type = docs.schema[id_col].dataType
    arrow_type = to_arrow_type(id_type)
    found = [_one_pass(docs, part, k, id_col, text_col, arrow_type, id_type.simpleString()) for part in _passes(queries, item_col, query_col)]
    ranked = functools.reduce(DataFrame.unionByName, found)
    by = Window.partitionBy("_q").orderBy(F.desc("score"), F.col("_d").asc_nulls_last())
    best = ranked.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return best.select(F.col("_q.item_id").alias(item_col), "rank", F.col("_d").alias(id_col), "score")


def _one_pass(docs: DataFrame, part: DataFrame, k: int, id_col: str, text_col: str, arrow_type: pa.DataType, id_name: str) -> DataFrame:
    items = sorted(part.collect(), key=lambda r: (str(r["item_id"]), r["text"] or ""))  # PASS_TERMS terms, about
    counts = [Counter(terms(r["text"])) for r in items]
    names = sorted(set().union(*counts))
    vocabulary = {t: i for i, t in enumerate(names)}
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    index = stage(texts.mapInArrow(_index_blocks(vocabulary, arrow_type), _INDEX), "postings")
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.frombuffer(row["ends"], np.int64)
                total[np.frombuffer(row["terms"], np.int32)] += np.diff(ends, prepend=0)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own], pa.int64())], ["term", "df"])

    dfs = np.zeros(len(names), np.int64)
    for term, df in index.select("terms", "ends").mapInArrow(document_counts, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        dfs[term] = df  # one row a term of this pass
    weights = np.array([idf(n_docs, int(d)) for d in dfs], np.int64)
    by_rarity = [sorted(((vocabulary[t], n) for t, n in c.items()), key=lambda p: (dfs[p[0]], p[0])) for c in counts]

    rarest = []
    for item in by_rarity:
        up_to = np.cumsum([dfs[t] for t, _ in item])
        rarest.append(item[:int(np.searchsorted(up_to, SEED_POSTINGS * k)) + 1])
    partial = index.mapInArrow(_seed(rarest, weights, n_docs, n_terms, k), "item int, score long") if n_terms else None
    floors = [1] * len(items)
    if partial is not None:
        order = Window.partitionBy("item").orderBy(F.desc("score"))
        kth = partial.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).filter(F.col("at") == k)
        for item, score in kth.select("item", "score").collect():  # at most one row an item
            floors[item] = max(1, score)

    found = index.mapInArrow(_search(by_rarity, floors, weights, n_docs, n_terms, k, arrow_type), f"item int, id {id_name}, score long")
    numbered = docs.sparkSession.createDataFrame([(i, r["item_id"], r["text"]) for i, r in enumerate(items)],
                                                 T.StructType([T.StructField("item", T.IntegerType()), *part.schema.fields]))
    side = small_side(numbered.select("item", F.struct("item_id", "text").alias("_q")))
    return found.join(side, "item").select("_q", F.col("id").alias("_d"), "score")
