"""Word-first backoff language identification: whole words, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import slices, stage

WORD = re.compile(r"[^\W\d_]+")
#: Fractions, superscripts and numerals are word characters to Python, but no letters.
LETTERS = regex.compile(r"\p{L}+")
NO_LANGUAGE = "und"
#: The fit takes this many rows of each language at most (all rows of smaller ones), chosen by a hash of the id.
TRAIN_ROWS = 3000
ORDERS = (4, 3, 2, 1)
#: Distinct words whose scores a task remembers before it starts anew.
CACHE_WORDS = 400_000


def words(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    return found if all(map(str.isalpha, found)) else [part for word in found for part in LETTERS.findall(word)]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its edges marked; order 1 leaves the edges out."""
    marked = word if n == 1 else f"^{word}$"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, gram, n) of each slice of texts; order 0 is the word itself."""
    for batch in slices(batches, "text"):
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(words(text or ""))
        rows = []
        for lang, found in seen.items():
            parts = {n: Counter() for n in ORDERS}
            for word, times in found.items():
                rows.append((lang, 0, word, times))
                for n in ORDERS:
                    for g in grams(word, n):
                        parts[n][g] += times
            rows += [(lang, n, g, times) for n in ORDERS for g, times in parts[n].items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(
            (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "n", "gram", "times"])


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        train_rows: int = TRAIN_ROWS) -> dict:
    """Frequencies of words and n-grams by language, from a bounded sample of ``df``'s rows.

    The sample keeps every row of a language with up to ``train_rows`` rows
    and, of others, those whose id hashes low. Every word and n-gram of the
    sample comes to the driver with its count in each language that has it, so
    the model grows with the sample's text, not with languages times entries.
    """
    known = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return {"langs": []}
    shares = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, train_rows / n)))])
    low = F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < shares[F.col(lang_col)] * 1_000_003
    counted = stage(known.filter(low).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(
        _counter, "lang string, n int, gram string, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times")), "counted")
    langs = sorted(sizes)
    entries = counted.toArrow()  # Arrow columns all the way: the driver holds no Python string of it
    entries = entries.take(pa.compute.sort_indices(entries, [(c, "ascending") for c in ("n", "gram", "lang")])).combine_chunks()
    own = pa.compute.index_in(entries["lang"], pa.array(langs)).to_numpy().astype(np.int32)
    order, times, gram = entries["n"].to_numpy(), entries["times"].to_numpy(), entries["gram"].combine_chunks()
    total = np.zeros((len(ORDERS) + 1, len(langs)))
    np.add.at(total, (order, own), times)
    # Log frequencies; half an occurrence where a language never has the entry.
    never = np.log(0.5 / (total + 1.0))
    more = np.log(times + 0.5) - np.log(0.5)
    new = np.ones(len(order), bool)
    new[1:] = (order[1:] != order[:-1]) | pa.compute.not_equal(gram.slice(1), gram.slice(0, max(0, len(gram) - 1))).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    return {"langs": langs, "grams": gram.take(pa.array(first)), "orders": order[first], "never": never,
            "starts": np.append(first, len(order)).astype(np.int64), "lang": own, "more": more.astype(np.float32)}


class Scorer:
    """Log frequency of a word in each language, less their mean: of the word if known, else of its longest known n-grams."""

    def __init__(self, model: dict):
        self.model = model
        self.known: dict[int, dict[str, int]] = {n: {} for n in (0, *ORDERS)}
        for i, (n, gram) in enumerate(zip(model["orders"].tolist(), model["grams"].to_pylist(), strict=True)):
            self.known[n][gram] = i
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model["langs"])), np.float32)

    def entries(self, word: str) -> tuple[int, list[int]]:
        """The order that answers for a word (0 the word itself) and the entries of it; order 1 without entries if none does."""
        known = self.known
        at = known[0].get(word)
        if at is not None:
            return 0, [at]
        for n in ORDERS:
            table = known[n]
            found = [table[g] for g in grams(word, n) if g in table]
            if found:
                return n, found
        return 1, []

    def scores(self, found: list[str]) -> np.ndarray:
        """One row per word, all at once: the mean over its entries."""
        model, k = self.model, len(self.model["langs"])
        parts = [self.entries(w) for w in found]
        sizes = np.array([len(p) for _, p in parts], np.int64)
        flat = np.fromiter((e for _, p in parts for e in p), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(found)), sizes)
        spans = model["starts"][flat + 1] - model["starts"][flat]
        at = np.repeat(model["starts"][flat] - np.cumsum(spans) + spans, spans) + np.arange(int(spans.sum()))
        weight = np.repeat(1.0 / sizes[word], spans) * model["more"][at]
        cell = np.repeat(word, spans) * k + model["lang"][at]
        rows = model["never"][[n for n, _ in parts]] + np.bincount(cell, weight, len(found) * k).reshape(-1, k)
        return np.where(sizes[:, None] > 0, rows - rows.mean(axis=1, keepdims=True), 0.0)

    def sums(self, found: list[str]) -> np.ndarray:
        index = self.index
        new = sorted(set(found).difference(index))
        if new:
            used = len(index)
            if used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((len(self.rows) + len(new), self.rows.shape[1]), np.float32)])
            self.rows[used:used + len(new)] = self.scores(new)
            index.update(zip(new, range(used, used + len(new)), strict=True))
        at = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
        total = self.rows[at].sum(axis=0, dtype=np.float64)
        if len(index) > CACHE_WORDS:
            self.forget()
        return total


def identify(text: str | None, scorer: Scorer | None, langs: list[str]) -> tuple[str, float]:
    """(language, score): ``und`` and 0 without a letter or without a model."""
    found = words(text) if text else []
    if not found or not langs:
        return NO_LANGUAGE, 0.0
    total = scorer.sums(found)
    odds = np.exp(total - total.max())
    best = int(np.argmax(total))
    return langs[best], float(odds[best] / odds.sum())


def predict(df: DataFrame, model: dict, text_col: str = "text"):
    """A column struct(lang_pred, score) for the whole text of each row.

    Null texts and texts without a letter (numbers, fractions and numerals are
    none) get ``und`` and 0; ties go to the language that sorts first; with no
    training rows every text is ``und``. Rows are independent: repeated ones
    get equal results, and a very long text is scored whole. Batches are
    whatever Arrow brings; memory is bounded by one batch and the remembered
    words.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        scorer = Scorer(known) if known["langs"] else None
        for texts in batches:
            yield pd.DataFrame([identify(t, scorer, known["langs"]) for t in texts], columns=["lang_pred", "score"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "lang_pred string, score double")(F.col(text_col))


def identify_documents(df: DataFrame, learn_from, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                       train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``df``'s id with lang_pred and score, learnt from rows where the ``learn_from`` condition holds."""
    model = fit(df.filter(learn_from), text_col, lang_col, id_col, train_rows)
    return df.select(F.col(id_col), predict(df, model, text_col).alias("_p")).select(id_col, "_p.lang_pred", "_p.score")
