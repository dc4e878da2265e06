"""M3 on the objective itself: linear quantile regression by majorise-minimise.

The pinball loss of a residual r lies below a parabola that touches it at the
present residual. Minimising the sum of the parabolas is a weighted least
squares problem, so a step is one aggregate of the weighted Gram matrix: each
task adds up its rows, tasks are added up by Spark, and the driver solves a
system of as many unknowns as there are columns. All levels go in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .evaluate import QUANTILES

STEPS, TOLERANCE = 40, 1e-6
#: Residuals are rounded off near zero at the first share of the label's spread, halved when a step gains little, down to the second.
SMOOTHING, LEAST_SMOOTHING = 1e-2, 1e-4


@dataclass
class QuantileLine:
    """Coefficients per level over (1, features, tickers but the first); losses of the steps, summed over levels."""

    features: list[str]
    tickers: list[str]
    coefficients: dict[str, list[float]]
    losses: list[float] = field(default_factory=list)

    def columns(self) -> list[Column]:
        """q10, q50 and q90 as expressions; a ticker that was not in the fit counts as the first one."""
        terms = [F.lit(1.0), *[F.col(c).cast("double") for c in self.features],
                 *[(F.col("ticker") == t).cast("double") for t in self.tickers[1:]]]
        out = []
        for q, line in self.coefficients.items():
            total = F.lit(0.0)
            for b, x in zip(line, terms):
                total = total + F.lit(float(b)) * x
            out.append(total.alias(q))
        return out

    def predict(self, df: DataFrame, keep: Sequence) -> DataFrame:
        return df.select(*keep, *self.columns())


def _step(levels: np.ndarray, lines: np.ndarray, epsilon: float):
    """Arrow function: rows to one row per task, the sums (Gram matrix, right side, loss) of every level, laid end to end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = lines.shape[1]
        total = np.zeros((len(levels), d * d + d + 1))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy().astype(np.float64)
            for k, level in enumerate(levels):
                r = y - x @ lines[k]
                v = w / (epsilon + np.abs(r))
                total[k, :d * d] += ((x * v[:, None]).T @ x).ravel()
                total[k, d * d:-1] += x.T @ (v * y) + (2 * level - 1) * (x.T @ w)
                total[k, -1] += (w * np.maximum(level * r, (level - 1) * r)).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])
    return run


def fit_lines(train: DataFrame, features: Sequence[str], target: str, tickers: Sequence[str], times: str | None = None,
              levels: dict[str, float] = QUANTILES, steps: int = STEPS) -> QuantileLine:
    """The lines that minimise the pinball loss of each level over the rows, ``times`` counting a row so often.

    Columns are centred and scaled first. After the last step the intercept is
    set to the exact quantile of the residuals, which can only lower the loss:
    as many labels lie below a line as its level asks, to within one row.
    Rows with a null feature or label are left out; without rows there is no
    fit and an error is raised.
    """
    features = list(features)
    weight = F.lit(1).cast("long") if times is None else F.col(times).cast("long")
    raw = train.select(*[F.col(c).cast("double").alias(c) for c in features], "ticker", F.col(target).cast("double").alias("_y"), weight.alias("_w")).dropna()
    names = [*features, *[f"_is_{i}" for i in range(1, len(tickers))]]
    wide = written(raw.select(*features, *[(F.col("ticker") == t).cast("double").alias(n) for n, t in zip(names[len(features):], list(tickers)[1:])], "_y", "_w"), "lines")
    stats = wide.agg(F.count("*").alias("n"), F.stddev_samp("_y").alias("s"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
                     *[F.stddev_samp(c).alias(f"d{i}") for i, c in enumerate(names)]).first()  # two numbers a column
    if not stats["n"]:
        raise ValueError("no rows to fit")
    means = np.array([stats[f"m{i}"] for i in range(len(names))])
    spreads = np.array([stats[f"d{i}"] or 1.0 for i in range(len(names))])
    scaled = [((F.col(c) - float(m)) / float(s)) for c, m, s in zip(names, means, spreads)]
    rows = written(wide.select(F.array(F.lit(1.0), *scaled).alias("x"), F.col("_y").alias("y"), F.col("_w").alias("w")), "scaled")

    asked, d = np.array(list(levels.values())), len(names) + 1
    lines = np.zeros((len(asked), d))
    spread, losses = float(stats["s"] or 1.0), []
    epsilon, least = SMOOTHING * spread, LEAST_SMOOTHING * spread
    best, best_loss = lines.copy(), np.full(len(asked), np.inf)
    for _ in range(steps):
        parts = rows.mapInArrow(_step(asked, lines, epsilon), "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
        summed = parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # levels x columns^2 numbers
        sums = np.array([r.v for r in summed]).reshape(len(asked), d * d + d + 1)
        better = sums[:, -1] < best_loss
        best[better], best_loss[better] = lines[better], sums[better, -1]
        losses.append(float(sums[:, -1].sum()))
        gain = losses[-2] - losses[-1] if len(losses) > 1 else np.inf
        if gain < 1e-3 * losses[-1]:
            if epsilon <= least and gain < TOLERANCE * losses[-1]:
                break
            epsilon = max(epsilon / 2, least)
        ridge = 1e-10 * np.eye(d)
        lines = np.stack([np.linalg.solve(s[:d * d].reshape(d, d) + ridge * np.trace(s[:d * d].reshape(d, d)), s[d * d:-1]) for s in sums])

    fitted = [sum((F.col("x")[i] * float(b) for i, b in enumerate(line) if i), F.lit(0.0)) for line in best]
    ends = rows.agg(*[F.percentile(F.col("y") - f, F.lit(float(a)), F.col("w")).alias(q)
                      for f, (q, a) in zip(fitted, levels.items())]).first()
    out = {}
    for line, q in zip(best, levels):
        slopes = line[1:] / spreads
        out[q] = [float(ends[q] - (slopes * means).sum()), *map(float, slopes)]
    return QuantileLine(features, list(tickers), out, losses)
