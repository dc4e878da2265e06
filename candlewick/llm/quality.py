"""Quality classifier by co-training: a text view and a metadata view label for each other, then vote calibrated.

The views of every row are written once. In each round both views score all
rows that have no label; a task keeps its surest ones, of which the surest of
all are handed to the other view. Only those and the labelled sample, a row of
numbers each, come to the driver.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.common import slices, stage

#: The fit takes this many labelled rows at most, by a hash of their id.
TRAIN_ROWS = 6000
#: Rounds of exchange; in each a view hands over the HANDED surest rows of the whole table of each class, none less sure than SURE.
ROUNDS, HANDED, SURE = 5, 400, 0.95
#: Every so many labelled rows of a class are kept from the views to calibrate them.
CALIBRATE_EVERY = 4
REJECT_BELOW = 0.5
SOURCE_SLOTS, LANG_SLOTS, WORD_SLOTS = 64, 16, 128
#: Distinct words whose slots a task remembers before it starts anew.
CACHE_WORDS = 400_000

_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SPACE, _STOPS = b" \t\n\x0b\x0c\r", b".,;:?'\"()-"
META = ("source", "lang", "n_chars")


_slots: dict[bytes, int] = {}


def _word_slot(word: bytes) -> int:
    if len(_slots) > CACHE_WORDS:
        _slots.clear()
    slot = _slots[word] = xxhash.xxh64_intdigest(word) % WORD_SLOTS
    return slot


def text_view(text: str | None) -> np.ndarray:
    """A whole text: shares of letters, capitals, digits, sentence marks and other symbols, of repetition, and of its words by hashed slot."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    share = lambda chars: 1 - len(data.translate(None, chars)) / size if data else 0.0
    letters, upper, digits, space, stops = map(share, (_LETTERS, _UPPER, _DIGITS, _SPACE, _STOPS))
    words = data.split()
    n = max(1, len(words))
    lines = [line for line in data.split(b"\n") if line]
    again = sum(map(operator.eq, words, words[1:])) / n
    found = Counter(words)
    slots = np.fromiter((s if (s := _slots.get(w)) is not None else _word_slot(w) for w in found), np.int64, len(found))
    often = np.bincount(slots, np.fromiter(found.values(), np.float64, len(found)), WORD_SLOTS)
    shares = [letters, upper / max(letters, 1e-9) if letters else 0.0, digits, space, stops, max(0.0, 1 - letters - digits - space - stops) if data else 0.0,
              again, 1 - len(set(lines)) / max(1, len(lines)), len(found) / n, np.log1p(len(words)), len(data) / n]
    return np.concatenate([shares, np.sqrt(often / n)])


def meta_numbers(source: str | None, lang: str | None, n_chars: int | None) -> tuple[float, float, float]:
    """Metadata of a document: log length, and the slots of its source and language; nulls have slot 0."""
    slot = lambda value, n: 0 if value is None else 1 + xxhash.xxh64_intdigest(str(value).encode("utf-8", "surrogatepass")) % (n - 1)
    return float(np.log1p(max(0, n_chars or 0))), float(slot(source, SOURCE_SLOTS)), float(slot(lang, LANG_SLOTS))


def meta_view(numbers: np.ndarray) -> np.ndarray:
    """Rows of ``meta_numbers`` with a column for every slot."""
    size, source, lang = numbers[:, 0], numbers[:, 1].astype(int), numbers[:, 2].astype(int)
    return np.concatenate([size[:, None], (size * size / 10)[:, None], np.eye(SOURCE_SLOTS)[source], np.eye(LANG_SLOTS)[lang]], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression (constant first) by damped Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    keep = ridge * len(x) * np.eye(x.shape[1])
    keep[0, 0] = 1e-9
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _odds(view: dict, x: np.ndarray) -> np.ndarray:
    return np.clip(np.c_[np.ones(len(x)), (x - view["mean"]) / view["scale"]] @ view["w"], -30, 30)


def _fit_view(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> dict:
    return {"mean": mean, "scale": scale, "w": _logistic((x - mean) / scale, y)}


def _calibrated(odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _logistic(odds[:, None], y, 1e-4)


def _surest(models: list[dict], number: np.ndarray, views: list[np.ndarray], taken: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(view, label, how sure, row number) of the HANDED surest rows of each view and class that are not taken."""
    out = []
    free = ~np.isin(number, taken)
    for k, model in enumerate(models):
        p = _sigmoid(_odds(model, views[k]))
        for label, sure in ((1, p), (0, 1 - p)):
            at = np.flatnonzero(free & (sure >= SURE))
            at = at[np.lexsort((number[at], -sure[at]))[:HANDED]]
            out += [(k, label, float(sure[i]), int(number[i])) for i in at]
    return out


class ArrayPool:
    """Rows without a label, in memory."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.views = [text, meta]

    def surest(self, models: list[dict], taken: np.ndarray) -> list[tuple[int, int, float, int]]:
        return _surest(models, np.arange(len(self.views[0])), self.views, taken)

    def rows(self, numbers: np.ndarray) -> list[np.ndarray]:
        return [v[numbers] for v in self.views]


class TablePool:
    """Rows without a label, as a written table (row, text, meta)."""

    def __init__(self, table: DataFrame):
        self.table = table

    def surest(self, models: list[dict], taken: np.ndarray) -> list[tuple[int, int, float, int]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rows = _surest(models, batch.column("row").to_numpy(), _read_views(batch), taken)
                    yield pa.RecordBatch.from_pylist([dict(zip(("view", "label", "sure", "row"), r)) for r in rows], _SUREST_ARROW)

        best = Window.partitionBy("view", "label").orderBy(F.desc("sure"), "row")  # tasks keep HANDED rows of each before the shuffle
        found = self.table.mapInArrow(run, "view int, label int, sure double, row long")
        kept = found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= HANDED).drop("at").collect()
        return sorted((tuple(r) for r in kept), key=lambda r: (r[0], -r[1], -r[2], r[3]))

    def rows(self, numbers: np.ndarray) -> list[np.ndarray]:
        asked = self.table.sparkSession.createDataFrame([(int(n),) for n in numbers], "asked long")  # 4 * HANDED rows at most
        got = self.table.join(F.broadcast(asked), F.col("row") == F.col("asked")).select("row", "text", "meta").toPandas().set_index("row").loc[numbers]
        return [np.array(got["text"].tolist(), float), meta_view(np.array(got["meta"].tolist(), float))]


_SUREST_ARROW = pa.schema([("view", pa.int32()), ("label", pa.int32()), ("sure", pa.float64()), ("row", pa.int64())])


def _read_views(batch: pa.RecordBatch) -> list[np.ndarray]:
    wide = lambda c: batch.column(c).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
    return [wide("text"), meta_view(wide("meta"))]


def train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool, mean: list[np.ndarray], scale: list[np.ndarray]) -> dict | None:
    """Both views' classifiers after the exchange, their calibration, and the weights that combine them.

    None without rows of both classes. A row goes once, to the view whose
    partner was the first to ask for it.
    """
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[::CALIBRATE_EVERY]] = True
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return None
    known = [(views[k][~held], y[~held]) for k in (0, 1)]
    taken = np.empty(0, np.int64)
    for _ in range(ROUNDS):
        models = [_fit_view(*known[k], mean[k], scale[k]) for k in (0, 1)]
        asked: dict[int, tuple[int, int]] = {}
        for k, label, _sure, row in pool.surest(models, taken):
            asked.setdefault(row, (k, label))
        if not asked:
            break
        numbers = np.array(list(asked), np.int64)
        given, of = pool.rows(numbers), np.array(list(asked.values()))
        for k in (0, 1):
            own = of[:, 0] == 1 - k
            known[k] = np.concatenate([known[k][0], given[k][own]]), np.concatenate([known[k][1], of[own, 1].astype(float)])
        taken = np.concatenate([taken, numbers])
    models = [_fit_view(*known[k], mean[k], scale[k]) for k in (0, 1)]
    odds = [_odds(m, views[k][held]) for k, m in enumerate(models)]
    curves = [_calibrated(o, y[held]) for o in odds]
    sure = np.stack([c[0] + c[1] * o for c, o in zip(curves, odds, strict=True)], axis=1)
    return {"views": models, "curves": curves, "vote": _logistic(np.clip(sure, -30, 30), y[held], 1e-4)}


def apply(model: dict | None, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Columns score, text_score and meta_score; all 1 without a model."""
    if model is None:
        return np.ones((len(views[0]), 3))
    odds = [c[0] + c[1] * _odds(m, v) for m, c, v in zip(model["views"], model["curves"], views, strict=True)]
    vote = np.c_[np.ones(len(odds[0])), np.clip(np.stack(odds, axis=1), -30, 30)] @ model["vote"]
    return np.stack([_sigmoid(vote), *map(_sigmoid, odds)], axis=1)


def _view_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float32())
    for batch in slices(batches, "text"):
        text = [text_view(t) for t in batch.column("text").to_pylist()]
        meta = [meta_numbers(*row) for row in zip(*(batch.column(c).to_pylist() for c in META), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("label"), pa.array(text, kind), pa.array(meta, kind)],
                                         names=["row", "label", "text", "meta"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and sums of squares of every column of both views, laid end to end, of a task's rows."""
    total = 0.0
    for batch in batches:
        if batch.num_rows:
            both = np.concatenate(_read_views(batch), axis=1)
            total = total + np.stack([both.sum(axis=0), (both * both).sum(axis=0)])
    if not np.isscalar(total):
        yield pa.RecordBatch.from_arrays([pa.array(range(total.shape[1]), pa.int32()), pa.array(total[0]), pa.array(total[1])], ["i", "s", "ss"])


def moments(table: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Mean and spread of each view's columns over all rows of (text, meta)."""
    n = max(1, table.count())
    sums = table.mapInArrow(_moments, "i int, s double, ss double").groupBy("i").agg(F.sum("s"), F.sum("ss")).orderBy("i").collect()  # a row a column
    s, ss = np.array([r[1] for r in sums]) / n, np.array([r[2] for r in sums]) / n
    cut = 2 + SOURCE_SLOTS + LANG_SLOTS
    split = lambda v: [v[:-cut], v[-cut:]]
    return split(s), split(np.sqrt(np.maximum(0, ss - s * s)) + 1e-6)


def _inputs(df: DataFrame, text_col: str) -> list:
    kinds = {"source": "string", "lang": "string", "n_chars": "long"}
    return [F.col(text_col).alias("text"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in META]]


def fit(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality",
        train_rows: int = TRAIN_ROWS) -> dict | None:
    """A model from a bounded sample, by a hash of the id, of labelled rows and from all other rows of ``df``.

    ``labels(id, label)`` with 1 for good; ids that have both labels count as
    unlabelled. None without labelled rows of both classes.
    """
    picked = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_l_id")).agg(
        F.min(label_col).cast("double").alias("label"), F.max(label_col).cast("double").alias("most")).filter("label = most").drop("most")
    picked = stage(picked.orderBy(F.xxhash64("_l_id"), "_l_id").limit(train_rows), "picked")
    rows = df.select(F.col(id_col).alias("_id"), *_inputs(df, text_col)).withColumn("row", F.monotonically_increasing_id())
    labelled = rows.join(F.broadcast(picked), F.col("_id") == F.col("_l_id"), "left").select("row", "label", "text", *META)
    views = stage(labelled.mapInArrow(_view_rows, "row long, label double, text array<float>, meta array<float>"), "views")
    got = views.filter("label IS NOT NULL").toPandas()  # train_rows rows, and repeats of their ids
    if got.empty:
        return None
    got["order"] = [tuple(t) + tuple(m) for t, m in zip(got["text"], got["meta"], strict=True)]
    mixed = got.sort_values(["order", "label"], kind="stable").sample(frac=1.0, random_state=5)
    known = np.array(mixed["text"].tolist(), float), meta_view(np.array(mixed["meta"].tolist(), float))
    return train(known, (mixed["label"].to_numpy() >= 0.5).astype(float), TablePool(views.filter("label IS NULL")), *moments(views))


def score(df: DataFrame, model: dict | None, text_col: str = "text"):
    """A column struct(score, text_score, meta_score): how likely each row is of good quality.

    Null and empty texts have the statistics of an empty text; missing or null
    metadata have slots of their own. Rows are independent: repeated ones get
    equal scores, an empty table none, and columns other than the text, source,
    lang and n_chars are not read. Without a model every score is 1.
    """
    import pandas as pd

    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(text, source, lang, n_chars):
        if not len(text):
            return pd.DataFrame({c: pd.Series(dtype=float) for c in ("score", "text_score", "meta_score")})
        numbers = [meta_numbers(s, g, None if n is None or n != n else int(n)) for s, g, n in zip(source, lang, n_chars, strict=True)]
        views = np.array([text_view(t) for t in text], np.float32).astype(float), meta_view(np.array(numbers, np.float32).astype(float))
        return pd.DataFrame(apply(shared.value, views), columns=["score", "text_score", "meta_score"])

    run.__annotations__ = dict.fromkeys(("text", "source", "lang", "n_chars"), pd.Series) | {"return": pd.DataFrame}
    return F.pandas_udf(run, "score double, text_score double, meta_score double")(*_inputs(df, text_col))


def keep_good(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``df`` that the classifier does not reject, with its columns; all of them without labels of both classes."""
    model = fit(df, labels, text_col, id_col)
    return df.filter(score(df, model, text_col)["score"] >= least)
