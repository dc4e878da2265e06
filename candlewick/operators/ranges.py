"""Sequence work on series of any length: ordered ranges of time, blocks of rows, as-of joins.

A window over a series puts the series into one task. Here time is cut into
ranges of about equal numbers of rows (approximate quantiles of the whole table,
one mergeable aggregate), so that a key with most of the rows is spread over
most of the ranges, and what one range needs from the earlier ones travels as
one row per (key, range): row counts, running totals or the last known values.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .seq import frame_sql, over_sql

RANGES = 256
#: Edges are looked up in two steps of this many.
_STEP = 16


def with_range(df: DataFrame, order: str, ranges: int = RANGES, name: str = "_r", edges_of: DataFrame | None = None) -> DataFrame:
    """Add the number of the range that ``order`` falls into; equal values share one, null has none.

    The edges only balance the work. ``edges_of`` (default ``df``) is the table whose ``order`` they cut evenly.
    """
    steps = max(1, -(-ranges // _STEP))
    n = steps * _STEP
    source = df if edges_of is None else edges_of
    edges = source.select(F.percentile_approx(order, [i / n for i in range(1, n)], 20_000).alias("e")).scalar()
    value = F.col(order)
    firsts = [F.get("_edges", i * _STEP - 1) for i in range(1, steps)]
    step = functools.reduce(lambda a, b: a + b, [F.when(e < value, 1).otherwise(0) for e in firsts], F.lit(0))
    inside = F.size(F.filter(F.slice("_edges", F.col("_step") * _STEP + 1, F.lit(_STEP - 1)), lambda e: e < value))
    stepped = df.withColumn("_edges", edges).withColumn("_step", F.coalesce(step, F.lit(0)))
    at = F.coalesce(F.col("_step") * _STEP + inside, F.lit(0)).cast("int")
    return stepped.withColumn(name, F.when(value.isNotNull(), at)).drop("_step", "_edges")


def _carried(parts: DataFrame, keys: Sequence[str], what: dict[str, Column]) -> DataFrame:
    """For every (key, range) in ``parts``, ``what`` over the earlier ranges of the key (one row per range)."""
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "_r", *[c.over(before).alias(n) for n, c in what.items()])


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = (), ranges: int = RANGES, name: str = "_rn") -> DataFrame:
    """Add each row's 0-based place in its series by (order, *tie), exact, without a task that holds the series."""
    ranged = with_range(df, order, ranges)
    sizes = ranged.groupBy(*keys, "_r").agg(F.count("*").alias("_r_size"))
    first = _carried(sizes, keys, {"_r_first": F.sum("_r_size")})
    inside = Window.partitionBy(*keys, "_r").orderBy(order, *tie)
    numbered = ranged.withColumn("_r_in", F.row_number().over(inside) - 1)
    return numbered.join(first, [*keys, "_r"]).withColumn(name, (F.coalesce("_r_first", F.lit(0)) + F.col("_r_in")).cast("long")).drop("_r", "_r_in", "_r_first")


def blocked(df: DataFrame, keys: Sequence[str], order: str, rows: int, before: int, after: int = 0, tie: Sequence[str] = (),
            block: str = "__block", own: str = "__own") -> DataFrame:
    """Every series as blocks of ``rows`` rows, each with copies of the rows around it.

    A block has its own rows (``own`` is true) and a halo of the last ``before``
    rows of the block before and the first ``after`` of the next one. A frame
    that reaches no further gives on an own row, by (keys, block), what it
    gives on the whole series. Keys and order must not be null.
    """
    if max(before, after) > rows:
        raise ValueError("a block must hold its neighbours' halo: rows >= before, after")
    at, within = F.floor(F.col("_rn") / rows).cast("int"), F.col("_rn") % rows
    copies = F.array(F.struct(at.alias("b"), F.lit(True).alias("own")),
                     F.when(within >= rows - before, F.struct((at + 1).alias("b"), F.lit(False).alias("own"))),
                     F.when((within < after) & (at > 0), F.struct((at - 1).alias("b"), F.lit(False).alias("own"))))
    numbered = row_numbers(df, keys, order, tie)
    return numbered.withColumn("_copy", F.explode(F.array_compact(copies))).withColumns(
        {block: F.col("_copy.b"), own: F.col("_copy.own")}).drop("_copy", "_rn")


def series_windows(df: DataFrame, keys: Sequence[str], order: str, rolling: Sequence[tuple[str, str, str, int, int]] = (),
                   shifts: Sequence[tuple[str, str, int]] = (), running: Sequence[tuple[str, str, str]] = (),
                   tie: Sequence[str] = (), rows: int = 4096) -> DataFrame:
    """W1, W6, W8, W9, W14 on series of any length: ``df`` with the named columns added.

    rolling: (name, aggregate, input, n, min_periods), null below min_periods non-null inputs;
    shifts: (name, input, k), the value k rows before (after, if negative);
    running: (name, sum | min | max | count, input) over the series up to the row, null where the input is.

    Frames are cut at blocks with a halo; running totals are those of the range
    plus one carried row per (key, range). Rows without key or order are dropped.
    """
    columns = [f"`{c}`" for c in df.columns]
    whole = df.dropna(subset=[*keys, order])
    back = max([0, *[n - 1 for *_, n, _ in rolling], *[k for *_, k in shifts]])
    ahead = max([0, *[-k for *_, k in shifts]])
    out = blocked(whole, keys, order, max(rows, back, ahead), back, ahead, tie) if rolling or shifts else whole
    sorted_by = ", ".join([order, *tie])
    if rolling or shifts:
        by = [*keys, "__block"]
        made = []
        for name, agg, x, n, least in rolling:
            frame = over_sql(by, sorted_by, frame_sql(-(n - 1), 0))
            made.append(f"(CASE WHEN count({x}) {frame} >= {least} THEN {agg}({x}) {frame} END) AS `{name}`")
        for name, x, k in shifts:
            made.append(f"{'lag' if k >= 0 else 'lead'}({x}, {abs(k)}) {over_sql(by, sorted_by)} AS `{name}`")
        out = out.selectExpr(*columns, "__own", *made).where("__own").drop("__own")
        columns = [f"`{c}`" for c in out.columns]
    if running:
        out = with_range(out, order)
        totals = {f"_t{i}": F.expr(f"{agg}({x})") for i, (_, agg, x) in enumerate(running)}
        merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
        carried = _carried(out.groupBy(*keys, "_r").agg(*[c.alias(n) for n, c in totals.items()]), keys,
                           {f"_t{i}": merge[agg](f"_t{i}") for i, (_, agg, _) in enumerate(running)})
        frame = over_sql([*keys, "_r"], sorted_by, frame_sql(None, 0))
        inner = out.selectExpr(*columns, "_r", *[f"{agg}({x}) {frame} AS _u{i}" for i, (_, agg, x) in enumerate(running)])
        both = {"sum": "coalesce(_t{i} + _u{i}, _t{i}, _u{i})", "count": "coalesce(_t{i}, 0) + _u{i}", "min": "least(_t{i}, _u{i})", "max": "greatest(_t{i}, _u{i})"}
        final = [f"(CASE WHEN {x} IS NOT NULL THEN {both[agg].format(i=i)} END) AS `{name}`" for i, (name, agg, x) in enumerate(running)]
        out = inner.join(carried, [*keys, "_r"]).selectExpr(*columns, *final)
    return out


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), values: Sequence[str] = (), right_on: str | None = None,
              tolerance: str | None = None, strict: bool = False, tie: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """Every row of ``left`` with the ``values`` of the last row of ``right`` at or before it under equal ``by`` keys.

    ``on`` (``right_on`` in ``right``, by default the same) is a date, a
    timestamp or a number. ``tolerance`` is an interval such as ``30 days`` (for
    numbers, a number): older rows do not match. ``strict`` leaves out rows at
    the same moment. Of several rows of ``right`` at one moment the one with the
    largest ``tie`` columns counts, then the one with the largest values.
    ``left`` rows without a match, and those whose key or moment is null, keep
    null values; no row of ``left`` is lost or doubled. Columns of ``left`` must
    differ from ``values``.

    Both sides are put into common time ranges. Within a (key, range) a window
    carries the last row on; a (key, range) that starts without one takes the
    last of the key's earlier ranges, from a table with one row per (key, range).
    """
    right_on = right_on or on
    keys = [f"_k{i}" for i in range(len(by))]
    held = F.struct(F.col(right_on).alias("_at"), *[F.col(v) for v in values])
    moment = dict(left.dtypes)[on]
    l = left.select(F.struct(*left.columns).alias("_l"), *[F.col(c).alias(k) for k, c in zip(keys, by)], F.col(on).alias("_at"),
                    F.lit(0 if strict else 1).alias("_src"), F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("_v"))
    found = right.dropna(subset=[right_on, *by]).groupBy(*[F.col(c).alias(k) for k, c in zip(keys, by)], F.col(right_on).cast(moment).alias("_at")).agg(
        F.max_by(held, F.struct(*tie, *values)).alias("_v") if [*tie, *values] else F.first(held).alias("_v"))
    r = found.select(F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), *keys, "_at", F.lit(1 if strict else 0).alias("_src"), "_v")
    placed = l.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, "_at"]))
    both = with_range(placed.unionByName(r), "_at", ranges)
    inside = Window.partitionBy(*keys, "_r").orderBy("_at", "_src").rowsBetween(Window.unboundedPreceding, 0)
    last = both.select("_l", *keys, "_r", "_at", F.last("_v", ignorenulls=True).over(inside).alias("_v")).where("_l IS NOT NULL")
    ends = both.groupBy(*keys, "_r").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias("_end"))
    carried = _carried(ends, keys, {"_carry": F.last("_end", ignorenulls=True)})
    matched = last.join(carried, [*keys, "_r"]).select("_l", "_at", F.coalesce("_v", "_carry").alias("_v"))
    if tolerance is not None:
        limit = F.expr(f"_v._at + {tolerance}") if moment in ("int", "bigint", "double", "float") else F.expr(f"_v._at + INTERVAL {tolerance}")
        matched = matched.withColumn("_v", F.when(F.col("_at") <= limit, F.col("_v")))
    unplaced = l.where(" OR ".join(f"{c} IS NULL" for c in [*keys, "_at"])).select("_l", "_at", "_v")
    return matched.unionByName(unplaced).select("_l.*", *[F.col(f"_v.{v}").alias(v) for v in values])
