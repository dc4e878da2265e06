"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import slices

TOKEN = re.compile(r"\w+")
#: The fit takes this many labelled texts of each class at most, longer ones than TRAIN_CHARS characters only for want of others.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1500, 3000, 20_000
#: A feature marks a toxic token if toxic texts have it this many times as often as clean ones, and so clearly that among all
#: features fewer than MARK_CHANCE would do so by chance.
MARK_RATIO, MARK_CHANCE = 20.0, 0.1
#: Of sampled texts that share this part of their five-word passages or more, the fit takes one under each label.
SAME = 0.8
PREFIXES = (4, 5, 6)
ROUNDS, STEP, DECAY = 25, 0.5, 1e-4
CACHE_WORDS = 400_000
SPAN_AT = 0.5
NO_TOKEN, MANY = -12.0, 4.0


def features(word: str) -> list[str]:
    """A token's own features: the word, and the prefixes that are shorter than it."""
    return [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) > k)]


def _mix(x: np.ndarray, to_t: tuple[float, float], to_o: tuple[float, float]) -> np.ndarray:
    """log((a e^x + b) / (c e^x + d)) without overflow."""
    big = np.maximum(x, 0)
    u, v = np.exp(x - big), np.exp(-big)
    return np.log((to_t[0] * u + to_t[1] * v) / (to_o[0] * u + to_o[1] * v))


def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling length: where each starts in the tokens, and how many reach each position."""
    by = np.argsort(-lengths, kind="stable")
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])[by]
    reach = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), "right")
    return by, start, reach


def forward_backward(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds (toxic over other) of each token of texts laid end to end.

    ``emit`` are the tokens' emission scores, ``move[i, j]`` the transition
    scores from state i to j (0 other, 1 toxic). All texts take a step at once.
    """
    a = np.exp(move)
    _, start, reach = _order(lengths)
    fore, back = np.empty(len(emit)), np.zeros(len(emit))
    r = np.zeros(0)
    for t, n in enumerate(reach.tolist()):
        at = start[:n] + t
        r = emit[at] + (_mix(r[:n], (a[1, 1], a[0, 1]), (a[1, 0], a[0, 0])) if t else 0.0)
        fore[at] = r
    for t in range(len(reach) - 2, -1, -1):
        at = start[:reach[t + 1]] + t
        back[at] = _mix(emit[at + 1] + back[at + 1], (a[1, 1], a[1, 0]), (a[0, 1], a[0, 0]))
    return fore, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _summary(odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each text: the highest marginal log odds, and the expected count of toxic tokens, as its log and up to MANY."""
    out = np.tile([NO_TOKEN, NO_TOKEN, 0.0], (len(lengths), 1))
    some = lengths > 0
    if some.any():
        start = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
        count = np.add.reduceat(_sigmoid(odds), start)
        out[some, 0] = np.clip(np.maximum.reduceat(odds, start), NO_TOKEN, -NO_TOKEN)
        out[some, 1], out[some, 2] = np.log(count + np.exp(NO_TOKEN)), np.minimum(count, MANY)
    return out


def _distinct(texts: list[list[str]], label: np.ndarray, hashes: int = 8) -> list[int]:
    """Texts that are no near copy of one kept before them under the same label.

    Near copies must not count as separate evidence. Texts are near copies if
    the share of five-word passages they have in common, estimated by equal
    least hashes, is SAME or more.
    """
    odd = np.random.default_rng(1).integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.empty((len(texts), hashes), np.uint64)
    seen = {y: np.empty((len(texts), hashes), np.uint64) for y in set(label.tolist())}
    size = dict.fromkeys(seen, 0)
    kept = []
    for i, (found, y) in enumerate(zip(texts, label.tolist(), strict=True)):
        grams = (" ".join(found[j:j + 5]) for j in range(max(1, len(found) - 4)))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64)
        least[i] = [((h * m) >> np.uint64(11)).min() for m in odd]
        if not ((seen[y][:size[y]] == least[i]).sum(axis=1) >= SAME * hashes).any():
            kept.append(i)
            seen[y][size[y]] = least[i]
            size[y] += 1
    return kept


def _marks(among: tuple[Counter, Counter], n_toxic: int, n_clean: int) -> set[str]:
    """Features that toxic texts have far too often for chance: a bound on the binomial tail, for as many tries as features."""
    share, bound = n_toxic / (n_toxic + n_clean), np.log(max(1, len(among[0] | among[1])) / MARK_CHANCE)
    found = set()
    for f, n in among[1].items():
        m = among[0][f]
        if n / n_toxic >= MARK_RATIO * (m + 0.5) / n_clean:
            seen = n / (n + m)
            if n * np.log(seen / share) + (m * np.log((1 - seen) / (1 - share)) if m else 0.0) >= bound:
                found.add(f)
    return found


def train(toxic: list[str], clean: list[str], share: float = 0.5) -> dict | None:
    """The field's weights, and the logistic curve that turns a text's marginals into its score.

    Token labels: in toxic texts, tokens with a feature that toxic texts have
    far more often than clean ones; every other token, and all of clean texts,
    is labelled other. The field is fitted to them by maximum likelihood.
    ``share`` is that of toxic texts among all labelled ones, to which the
    curve is weighted.
    """
    texts = [TOKEN.findall(t.lower()) for t in toxic + clean]
    label = np.array([1] * len(toxic) + [0] * len(clean))
    kept = _distinct(texts, label) if texts else []
    texts, label = [texts[i] for i in kept], label[kept]
    if len(set(label.tolist())) < 2:
        return None
    among = (Counter(), Counter())
    for found, y in zip(texts, label.tolist(), strict=True):
        among[y].update({f for w in set(found) for f in features(w)})
    n_clean, n_toxic = int((label == 0).sum()), int(label.sum())
    marks = _marks(among, n_toxic, n_clean)

    types: dict[str, int] = {}
    lengths = np.array([len(t) for t in texts])
    token = np.array([types.setdefault(w, len(types)) for t in texts for w in t], np.int64)
    columns: dict[str, int] = {}
    of = np.full((len(types), 1 + len(PREFIXES)), -1)
    for w, i in types.items():
        for k, f in enumerate(features(w)):
            if among[0][f] + among[1][f] > 1:
                of[i, k] = columns.setdefault(f, len(columns))
    marked = np.array([any(f in marks for f in features(w)) for w in types], bool)
    truth = marked[token] & np.repeat(label == 1, lengths)
    own = of >= 0

    weight, bias, move = np.zeros(len(columns) + 1), np.log((truth.sum() + 1) / len(truth)), np.zeros((2, 2))
    speed = [np.full(len(weight), 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    last = np.zeros(len(token), bool)
    last[np.cumsum(lengths[lengths > 0]) - 1] = True
    first = np.flatnonzero(~last)
    pairs = np.array([[(~truth[first] & ~truth[first + 1]).sum(), (~truth[first] & truth[first + 1]).sum()],
                      [(truth[first] & ~truth[first + 1]).sum(), (truth[first] & truth[first + 1]).sum()]], float)
    filled = lengths[lengths > 0]
    for _ in range(ROUNDS):
        emit = ((weight[of] * own).sum(axis=1) + bias)[token]
        fore, back = forward_backward(emit, filled, move)
        miss = truth - _sigmoid(fore + back)
        per_type = np.bincount(token, miss, len(types))
        slope = np.bincount(of[own], np.repeat(per_type, own.sum(axis=1)), len(weight)) - DECAY * len(texts) * weight
        x, y = np.clip(fore[first], -30, 30), np.clip(emit[first + 1] + back[first + 1], -30, 30)
        mass = np.stack([np.ones_like(x), np.exp(y), np.exp(x), np.exp(x + y)]) * np.exp(move).reshape(4, 1)
        slopes = [slope, per_type.sum(), pairs - (mass / mass.sum(axis=0)).sum(axis=1).reshape(2, 2)]
        speed = [s + g * g for s, g in zip(speed, slopes, strict=True)]
        weight, bias, move = (p + STEP * g / np.sqrt(s) for p, g, s in zip((weight, bias, move), slopes, speed, strict=True))

    fore, back = forward_backward(((weight[of] * own).sum(axis=1) + bias)[token], filled, move)
    curve = _logistic(_summary(fore + back, lengths), label, share)
    return {"weights": {f: float(weight[i]) for f, i in columns.items() if abs(weight[i]) > 1e-3}, "bias": float(bias), "move": move, "curve": curve}


def _logistic(x: np.ndarray, y: np.ndarray, part: float, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's steps with a small ridge; class 1 has this part of the weight."""
    x = np.c_[np.ones(len(x)), x]
    share = np.where(y == 1, part / max(y.mean(), 1e-9), (1 - part) / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(len(w)) * len(x)
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge * 1e-2, x.T @ (share * (y - p)) - ridge @ w * 1e-2)
        w += np.clip(step, -2, 2)
    return w


class _Emissions(dict):
    """Emission score of a word, remembered; starts anew when it holds too many words."""

    def __init__(self, model: dict):
        super().__init__()
        self.weights, self.bias = model["weights"], model["bias"]

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        score = self[word] = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
        return score


def score_texts(texts: list[str | None], model: dict, emissions: dict) -> tuple[np.ndarray, list[list[dict]]]:
    """(scores, spans of characters of the lower-cased text tagged toxic) of a slice of texts."""
    found = [TOKEN.findall(t.lower()) if t else [] for t in texts]
    lengths = np.array([len(f) for f in found])
    emit = np.concatenate([np.empty(0), *(np.fromiter(map(emissions.__getitem__, f), float, len(f)) for f in found)])
    filled = lengths[lengths > 0]
    fore, back = forward_backward(emit, filled, model["move"])
    odds = fore + back
    score = _sigmoid(np.c_[np.ones(len(texts)), _summary(odds, lengths)] @ model["curve"])
    tagged, spans, at = _sigmoid(odds) >= SPAN_AT, [], 0
    for text, n in zip(texts, lengths.tolist(), strict=True):
        spans.append(_spans(text, tagged[at:at + n]) if tagged[at:at + n].any() else [])
        at += n
    return score, spans


def _spans(text: str, tagged: np.ndarray) -> list[dict]:
    out, before = [], False
    for m, bad in zip(TOKEN.finditer(text.lower()), tagged.tolist(), strict=True):
        if bad and before:
            out[-1]["end"] = m.end()
        elif bad:
            out.append({"start": m.start(), "end": m.end()})
        before = bad
    return out


def fit(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
        n_toxic: int = TRAIN_TOXIC, n_clean: int = TRAIN_CLEAN, max_chars: int = TRAIN_CHARS) -> dict | None:
    """A model from a bounded sample of the labelled rows, chosen by a hash of their id.

    ``labels(id, label)`` with 1 for toxic. The sample has n_toxic + n_clean
    rows, which alone come to the driver: texts over max_chars characters only
    where there are too few others, whole, and as many as keep the sample
    within as many characters as rows of max_chars would have (one at least).
    None if either class is missing. Ids with both labels are in both classes;
    rows repeated count once.
    """
    sizes = {r[0]: r[1] for r in labels.filter(F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}
    if len(sizes) < 2:
        return None
    parts = []
    for value, limit in ((1, n_toxic), (0, n_clean)):
        rows = labels.filter(F.col(label_col) == value).select(F.col(id_col).alias("_l_id")).distinct()
        narrow = df.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("h"), F.length(text_col).alias("n")).filter("n IS NOT NULL")
        held = narrow.join(rows, F.col("_id") == F.col("_l_id")).groupBy("_id", "h").agg(F.first("n").alias("n"))
        order = [F.col("n") > max_chars, F.xxhash64("_id"), "_id", "h"]
        pick = held.orderBy(*order).limit(limit).toPandas()  # ids and lengths
        within = pick[(pick["n"].cumsum() <= limit * max_chars) | (pick.index == 0)]
        asked = df.sparkSession.createDataFrame(list(within[["_id", "h"]].itertuples(index=False, name=None)), held.select("_id", "h").schema)
        texts = (df.select(F.col(id_col).alias("_d_id"), F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("_d_h"))
                 .join(F.broadcast(asked), (F.col("_d_id") == F.col("_id")) & (F.col("_d_h") == F.col("h")))
                 .select("t", "h").dropDuplicates(["t", "h"]).orderBy("h").toPandas())
        parts.append(texts["t"].tolist())
    return train(*parts, sizes[1] / (sizes[0] + sizes[1]))


def tag(df: DataFrame, model: dict | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: id, score, spans (start and end characters in the lower-cased text).

    Null and empty texts have no token: their score is the curve's value for
    none. Rows are independent: repeated ones get equal results, null ids are
    kept, an empty table gives no row, a very long text is scored whole.
    Without a model every score is 0 and no span is tagged.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        emissions = _Emissions(known) if known else {}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            score, spans = score_texts(texts, known, emissions) if known else (np.zeros(len(texts)), [[]] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array(spans, kind)], names=["id", "score", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, score double, spans array<struct<start:int,end:int>>").withColumnRenamed("id", id_col))
