"""Spelling variants: near words by bidirectional FM-index search schemes.

Two words are near if one insertion, deletion or replacement of a code point
turns one into the other. The edit leaves one half of a word as it is, so every
near word is found by matching a half exactly and extending across the other
with one error: the second half from the word's end to the left on an index of
the delimited vocabulary, the first half from the word's start to the right on
an index of the reversed vocabulary. Matches are intervals of suffix ranks.

A vocabulary of any size is cut into segments: both words of a pair share their
first code points (an edit in the second half) or their last ones (an edit in
the first), as many as a half of the shortest word has. Words with the same
start, or end, go to one segment while they are few; where they are many, both
the indexed and the asking words are dealt to parts, with a segment for every
pair of parts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import partitions, slices, small_side, stage

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
RUN = "[A-Za-zÀ-ÿ]+"
#: Indexed words of a segment, about; a start or end that more words share is dealt to several segments.
SEGMENT_WORDS = 20_000
#: Distinct words a task counts before it hands its counts on.
HELD_WORDS = 400_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FORWARD, REVERSED = 0, 1


def misspell(prefix_crc: int, run: str) -> str:
    """The run, less one code point where 31 divides the crc32 of ``<id>:<run>``."""
    h = zlib.crc32(run.encode("utf-8"), prefix_crc)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = RUN,
                rule: Callable[[int, str], str] = misspell, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): lower-cased runs of whole texts after ``rule``, long and frequent enough.

    ``rule`` gets the crc32 of ``<id>:`` and a run, and may shorten it. Null texts have no runs; a null id reads as empty.
    """
    runs = re.compile(pattern)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in slices(batches, "text"):
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                crc = zlib.crc32(f"{'' if key is None else key}:".encode())
                for run, n in Counter(runs.findall((text or "").translate(_LOWER))).items():
                    if len(run) >= min_chars:
                        word = rule(crc, run)
                        if len(word) >= min_chars:
                            total[word] += n
            if len(total) > HELD_WORDS:
                yield flush()
        yield flush()

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class FmIndex:
    """FM-index of words laid out as ``$word$word$``: one sorted array of (code, place in the last column) answers every rank."""

    def __init__(self, words: list[str]):
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet = np.unique(points)
        self.letters = len(self.alphabet)
        self.text, starts, _ = self.laid_out(words)  # code 0 is the delimiter
        self.suffixes = self._sorted_suffixes()
        self.last = self.text[self.suffixes - 1]  # the code before each suffix, in suffix order
        self.width = len(self.text) + 1
        self.ranks = np.sort(self.last * self.width + np.arange(len(self.text)))
        self.word_at = np.full(len(self.text), -1, np.int64)
        self.word_at[starts - 1] = np.arange(len(words))

    def laid_out(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of ``$word$word$``, where each word starts, and the words' lengths; letters the index does not hold have a code that matches nothing."""
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths + 1) - lengths
        codes = np.zeros(int(lengths.sum()) + len(words) + 1, np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.searchsorted(self.alphabet, points)
        known = code < self.letters
        known[known] = self.alphabet[code[known]] == points[known]
        codes[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(len(points))] = np.where(known, code, self.letters) + 1
        return codes, starts, lengths

    def _sorted_suffixes(self) -> np.ndarray:
        rank, size, n = self.text, 1, len(self.text)
        while True:
            after = np.zeros(n, np.int64)
            after[:max(0, n - size)] = rank[size:] + 1
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
            if rank[order[-1]] == n - 1 or size >= n:
                return order
            size *= 2

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that have ``code`` before those of [low, high)."""
        return np.searchsorted(self.ranks, code * self.width + low), np.searchsorted(self.ranks, code * self.width + high)

    def letters_before(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval number, code) of letters that stand before suffixes of the intervals: the narrow ones' own, all for wide ones."""
        size = high - low
        wide = np.flatnonzero(size > self.letters)
        narrow = np.flatnonzero((size <= self.letters) & (size > 0))
        each = np.repeat(narrow, size[narrow])
        place = np.arange(len(each)) - np.repeat(np.cumsum(size[narrow]) - size[narrow], size[narrow]) + low[each]
        pairs = np.unique(each * (self.letters + 1) + self.last[place])
        pairs = pairs[pairs % (self.letters + 1) > 0]
        all_of = np.repeat(wide, self.letters)
        return (np.concatenate([pairs // (self.letters + 1), all_of]),
                np.concatenate([pairs % (self.letters + 1), np.tile(np.arange(1, self.letters + 1), len(wide))]))

    def near(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, indexed word) whose edit lies before the last ``exact`` code points of the query.

        All queries are asked at once: first their exact parts, with the
        delimiter that ends them, are matched to the left; then the rest, with
        the intervals of no error and those of one error side by side, a code
        point at a time.
        """
        text, starts, lengths = self.laid_out(queries)
        asked = np.arange(len(lengths))
        at = starts + lengths  # place of the code point matched last: the delimiter
        low, high = self.extend(np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), np.full(len(asked), len(self.text)))
        for step in range(int(exact.max(initial=0))):
            on = np.flatnonzero(step < exact)
            at[on] -= 1
            low[on], high[on] = self.extend(text[at[on]], low[on], high[on])
        empty = np.empty(0, np.int64)
        words, w_low, w_high = empty, empty, empty  # one error made; they stand where their word's error-free interval stands
        found: list[tuple[np.ndarray, np.ndarray]] = []
        left = lengths - exact
        while len(asked):
            # A code point more than the word has.
            own, code = self.letters_before(low, high)
            l, h = self.extend(code, low[own], high[own])
            words, w_low, w_high = self._merged(np.concatenate([words, asked[own]]), np.concatenate([w_low, l]), np.concatenate([w_high, h]))
            # Words read to their start: only the delimiter is left.
            done = left[words] == 0
            l, h = self.extend(np.zeros(int(done.sum()), np.int64), w_low[done], w_high[done])
            hit = h > l
            found.append((words[done][hit], self.word_at[self.suffixes[l[hit]]]))
            words, w_low, w_high = words[~done], w_low[~done], w_high[~done]
            on = left[asked] > 0
            asked, low, high = asked[on], low[on], high[on]
            if not len(asked):
                break
            # One code point to the left: as it is, replaced, or left out.
            mine = text[starts[words] + left[words] - 1]
            w_low, w_high = self.extend(mine, w_low, w_high)
            mine = text[starts[asked] + left[asked] - 1]
            own, code = self.letters_before(low, high)
            other = code != mine[own]
            own, code = own[other], code[other]
            l, h = self.extend(code, low[own], high[own])
            words = np.concatenate([words, asked[own], asked])
            w_low, w_high = np.concatenate([w_low, l, low]), np.concatenate([w_high, h, high])
            low, high = self.extend(mine, low, high)
            left[asked] -= 1
            left_on = w_high > w_low
            words, w_low, w_high = words[left_on], w_low[left_on], w_high[left_on]
        if not found:
            return empty, empty
        wide = len(self.text)
        pairs = np.unique(np.concatenate([a for a, _ in found]) * wide + np.concatenate([b for _, b in found]))
        return pairs // wide, pairs % wide

    def _merged(self, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The non-empty intervals, each (word, interval) once."""
        on = high > low
        words, low, high = words[on], low[on], high[on]
        order = np.lexsort((high, low, words))
        words, low, high = words[order], low[order], high[order]
        new = np.ones(len(words), bool)
        new[1:] = (np.diff(words) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
        return words[new], low[new], high[new]


def _search(key: tuple, table: pa.Table) -> pa.Table:
    """Of a segment: each asked word's number of near indexed words, and the most frequent of them."""
    side = key[1].as_py()
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("word", "n", "indexed", "asked"))))
    words, counts, indexed, asked = map(list, zip(*rows))
    held, sought = np.flatnonzero(indexed), np.flatnonzero(asked)
    lengths = np.array([len(w) for w in words], np.int64)
    exact = lengths // 2 if side == REVERSED else lengths - lengths // 2
    as_read = [w[::-1] for w in words] if side == REVERSED else words
    asked, near = FmIndex([as_read[i] for i in held]).near([as_read[i] for i in sought], exact[sought])
    asked, near = sought[asked], held[near]
    if side == FORWARD:
        # Found from the first half as well, which is where it counts.
        on = np.array([words[b][:len(words[a]) // 2] != words[a][:len(words[a]) // 2] for a, b in zip(asked.tolist(), near.tolist())], bool)
        asked, near = asked[on], near[on]
    n = np.array(counts, np.int64)
    order = np.lexsort((near, -n[near], asked))  # words are in code-point order
    asked, near = asked[order], near[order]
    own, first, size = np.unique(asked, return_index=True, return_counts=True)
    best = near[first]
    return pa.table({"word": pa.array([words[i] for i in own], pa.string()), "n_near": pa.array(size, pa.int64()),
                     "best_n": pa.array(n[best], pa.int64()), "best": pa.array([words[i] for i in best], pa.string())})


def near_words(words: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have a near word; ``words(word, n)`` holds distinct ones of ``min_chars`` or more.

    best is the near word of largest n, of equal ones the first in code-point
    order. Only counts and best words leave a segment, never its pairs.
    """
    head, tail = min_chars // 2, min_chars - min_chars // 2
    keys = F.array(F.struct(F.lit(REVERSED).alias("side"), F.substring("word", 1, head).alias("key")),
                   F.struct(F.lit(FORWARD).alias("side"), F.substring("word", -tail, tail).alias("key")))
    keyed = words.select("word", "n", F.explode(keys).alias("k")).select("word", "n", "k.side", "k.key")
    sizes = keyed.groupBy("side", "key").agg(F.count("*").alias("size"))
    many = stage(sizes.filter(F.col("size") > SEGMENT_WORDS).select("side", "key", F.ceil(F.col("size") / SEGMENT_WORDS).alias("parts")), "hot-keys")
    n_segments = max(partitions(words.sparkSession), -(-words.count() // SEGMENT_WORDS))
    parted = keyed.join(small_side(many), ["side", "key"], "left").fillna(1, "parts").withColumn("part", F.pmod(F.xxhash64("word"), "parts"))
    # A hot key has a segment for each pair of an indexed and an asking part.
    cells = F.explode(F.expr("""array_distinct(concat(transform(sequence(0, parts - 1), i -> struct(part AS held, i AS asking)),
                                                      transform(sequence(0, parts - 1), i -> struct(i AS held, part AS asking))))"""))
    dealt = parted.select("*", cells.alias("cell")).select(
        "word", "n", "side", (F.col("cell.held") == F.col("part")).alias("indexed"), (F.col("cell.asking") == F.col("part")).alias("asked"),
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("key"), F.lit(n_segments))).otherwise(F.xxhash64("key", "cell")).alias("segment"))
    found = dealt.groupBy("segment", "side").applyInArrow(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("b"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.b").alias("best"), (-F.col("best.m")).alias("best_n"))


def variant_groups(words: DataFrame, min_chars: int = MIN_CHARS, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of ``words(word, n)`` with its form and the root of its group.

    A word's form is its best near word if that is ``ratio`` times as frequent
    at least, else null; root is the end of the chain of forms, the word itself
    if it has none. Frequencies grow by ``ratio`` along a chain, so its length
    is logarithmic, and it is halved by every join of the links with themselves.
    An empty vocabulary gives no row.
    """
    words = stage(words, "words")
    found = stage(near_words(words, min_chars), "near-words")
    joined = stage(words.join(found, "word", "left").withColumn("formed", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("formed"), F.col("best")).alias("form"), F.when(F.col("formed"), F.col("best_n")).alias("form_n")), "forms")
    links = joined.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("above"))
        links = stage(links.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if links.filter("moved").isEmpty():
            break
        links = links.select("word", "root")
    roots = links.select("word", F.col("root").alias("_root"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = RUN,
                      rule: Callable[[int, str], str] = misspell, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
                      ratio: int = RATIO) -> DataFrame:
    """The vocabulary of whole texts, its near words and variant groups (see ``count_words`` and ``variant_groups``).

    Null and empty texts have no words, repeated rows count as often as they
    occur, an empty table gives no row. Columns other than id and text are not
    read. A very long text is counted in one task, word by word.
    """
    return variant_groups(count_words(docs, id_col, text_col, pattern, rule, min_chars, min_count), min_chars, ratio)
