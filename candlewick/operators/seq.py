"""Sequence operators over per-series windows (shift, rolling, cumulative, EWM).

Every window is partitioned by the series key (ticker, or ticker + candle), so
one series is processed by one task.  A series is a calendar of trading rows
(one row per date), so its length is bounded by the calendar, not by the
volume of the raw data behind it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series_window(keys: Sequence[str] = ("ticker",), order: str = "Date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def rolling(agg, x: Column, w: WindowSpec, n: int, min_periods: int | None = None,
            start: int | None = None, end: int = 0) -> Column:
    """pandas ``rolling(n, min_periods)`` over the frame [start, end] rows.

    The result is NULL until the frame holds ``min_periods`` (default n)
    non-null values.  ``start``/``end`` default to the trailing frame
    [-(n-1), 0]; the closed-candle form of the reference,
    ``rolling(n).sum().shift(1)``, is ``start=-n, end=-1``.
    """
    if start is None:
        start = -(n - 1) + end
    frame = w.rowsBetween(start, end)
    need = n if min_periods is None else min_periods
    return F.when(F.count(x).over(frame) >= need, agg(x).over(frame))


# ---------------------------------------------------------------- SQL-text forms
# The indicator plans carry hundreds of window expressions; building them as
# SQL text and projecting with ``selectExpr`` costs one driver->JVM call per
# projection instead of several per expression.

def over_sql(keys: Sequence[str], order: str, frame: str = "") -> str:
    return f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {order}{' ' + frame if frame else ''})"


def frame_sql(start: int | None, end: int | None) -> str:
    def bound(v, side):
        if v is None:
            return f"UNBOUNDED {side}"
        if v == 0:
            return "CURRENT ROW"
        return f"{-v} PRECEDING" if v < 0 else f"{v} FOLLOWING"
    return f"ROWS BETWEEN {bound(start, 'PRECEDING')} AND {bound(end, 'FOLLOWING')}"


def shift_sql(x: str, keys: Sequence[str], order: str, k: int = 1) -> str:
    fn = "lag" if k >= 0 else "lead"
    return f"{fn}({x}, {abs(k)}) {over_sql(keys, order)}"


def rolling_sql(agg: str, x: str, keys: Sequence[str], order: str, n: int,
                min_periods: int | None = None, start: int | None = None, end: int = 0) -> str:
    """SQL form of ``rolling``: NULL until the frame holds min_periods values."""
    if start is None:
        start = -(n - 1) + end
    o = over_sql(keys, order, frame_sql(start, end))
    return f"(CASE WHEN count({x}) {o} >= {n if min_periods is None else min_periods} THEN {agg}({x}) {o} END)"


def running_sql(agg: str, x: str, keys: Sequence[str], order: str) -> str:
    o = over_sql(keys, order, frame_sql(None, 0))
    return f"(CASE WHEN {x} IS NOT NULL THEN {agg}({x}) {o} END)"


def ewm_mean(df: DataFrame, specs: Sequence[tuple[str, str, float]], keys: Sequence[str], order: str) -> DataFrame:
    """Add ``ewm(alpha, adjust=False).mean()`` columns: y0 = x0, yt = a*xt + (1-a)*y(t-1).

    specs: (output name, input SQL expression, alpha).  Rows before the first
    non-null input give NULL; a NULL input after that carries the previous value.

    A series is cut into blocks of rows.  After k non-null inputs of its block
    a row's value is (1-a)^k * carry + the block's own weighted inputs, which
    are one running sum of x * (1-a)^-k: exact up to rounding as long as the
    power stays in a double's range, which sets the length of a block.  The
    last values of the blocks (one row per block, not per input row) are folded
    in order per series and the carry of each block is joined back.  There is
    no bound on the length of a series, and every output stands alone, so
    pruning some of them changes none of the others.
    """
    if any(not 0 < a < 1 for _, _, a in specs):
        raise ValueError("alpha must lie between 0 and 1")
    size = min(512, *(int(800 / -math.log2(1 - a)) for _, _, a in specs))
    base = [f"`{c}`" for c in df.columns]
    n = range(len(specs))
    run = over_sql(keys, order, frame_sql(None, 0))
    out = df.selectExpr(*base, f"CAST(floor((row_number() {over_sql(keys, order)} - 1) / {size}) AS INT) AS __ewm_block",
                        *[f"count({x}) {run} AS __ewm_s{i}" for i, (_, x, _) in enumerate(specs)])
    block = over_sql([*keys, "__ewm_block"], order, frame_sql(None, 0))
    seen = ["__ewm_block", *[f"__ewm_s{i}" for i in n]]
    out = out.selectExpr(*base, *seen, *[f"count({x}) {block} AS __ewm_k{i}" for i, (_, x, _) in enumerate(specs)])
    part = []
    for i, (_, x, a) in enumerate(specs):
        weight = f"(CASE WHEN __ewm_s{i} = 1 THEN 1.0D ELSE {float(a)!r}D END)"
        part.append(f"coalesce(sum(CAST({x} AS DOUBLE) * {weight} * pow({1.0 - a!r}D, -__ewm_k{i})) {block}, 0.0D) "
                    f"* pow({1.0 - a!r}D, __ewm_k{i}) AS __ewm_b{i}")
    out = out.selectExpr(*base, *seen, *[f"__ewm_k{i}" for i in n], *part)
    ends = out.groupBy(*keys, "__ewm_block").agg(*[F.expr(e) for i, (_, _, a) in enumerate(specs) for e in (
        f"pow({1.0 - a!r}D, max(__ewm_k{i})) AS a{i}", f"max_by(__ewm_b{i}, {order}) AS b{i}")])
    maps = ", ".join(f"a{i}, b{i}" for i in n)
    folded = ends.groupBy(*keys).agg(F.expr(f"sort_array(collect_list(struct(__ewm_block, {maps})))").alias("__ewm_ends"))
    carry = [f"aggregate(__ewm_ends, struct(0.0D AS y, CAST(array() AS ARRAY<DOUBLE>) AS before), "
             f"(s, e) -> struct(e.a{i} * s.y + e.b{i} AS y, concat(s.before, array(s.y)) AS before), s -> s.before) AS c{i}" for i in n]
    carries = (folded.selectExpr(*keys, *carry).selectExpr(*keys, f"inline(arrays_zip({', '.join(f'c{i}' for i in n)}, "
                                                            "sequence(0, size(c0) - 1)))")
               .toDF(*keys, *[f"__ewm_c{i}" for i in n], "__ewm_block"))
    final = []
    for i, (name, _, a) in enumerate(specs):
        final.append(f"CASE WHEN __ewm_s{i} > 0 THEN pow({1.0 - a!r}D, __ewm_k{i}) * __ewm_c{i} + __ewm_b{i} END AS `{name}`")
    return out.join(carries, [*keys, "__ewm_block"]).selectExpr(*base, *final)
