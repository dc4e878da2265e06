"""Null-safe arithmetic column expressions.

Missing values are SQL NULLs.  Division never raises under ANSI mode: a zero or
missing denominator yields NULL (the reference's ``safe_div``; for raw price
ratios this replaces pandas' +/-inf with NULL, see SURVEY S1/S2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_d(v: float) -> Column:
    return F.lit(float(v))


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 or NULL."""
    return F.try_divide(num, den)


def pct_change(cur: Column, prev: Column) -> Column:
    """(cur / prev - 1) * 100 with NULL for a zero or missing previous value."""
    return (safe_div(cur, prev) - 1.0) * 100.0


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x < lo, lit_d(lo)).when(x > hi, lit_d(hi)).otherwise(x)


def nan_to_null(x: Column) -> Column:
    """NaN and +/-inf become NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


# Grid used to make double results comparable between engines: values are
# rounded to a multiple of 2**-20, an exact binary scaling, so two engines that
# differ only in the last bits of a sum land on the same value.
GRID = 1048576.0
