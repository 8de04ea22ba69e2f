"""Small Column builders shared by all operators.

Missing values follow one rule: NaN and infinities become NULL where they arise, aggregates skip
NULL, and defaults are filled in at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def lit(x: float) -> Column:
    return F.lit(float(x))


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def nonzero(c: Column) -> Column:
    return F.when(c != 0.0, c)


def bar_return(close: Column, prev: Column) -> Column:
    """Change since the bar before; NULL, which counts as no change, where that bar is missing or its price is 0."""
    return close / nonzero(prev) - 1.0


def log_ratio(a: Column, b: Column) -> Column:
    return finite(F.ln((a + EPS) / (b + EPS)))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Limit a value; NULL stays NULL."""
    out = c
    if lo is not None:
        out = F.greatest(out, lit(lo))
    if hi is not None:
        out = F.least(out, lit(hi))
    return F.when(c.isNotNull(), out)


def clip01(c: Column) -> Column:
    return clip(c, 0.0, 1.0)


def flag(c: Column) -> Column:
    """Boolean with NULL read as false."""
    return F.coalesce(c, F.lit(False))


def crossed_above(prev: Column, cur: Column, level: Column | float) -> Column:
    level = lit(level) if isinstance(level, (int, float)) else level
    return flag((prev <= level) & (cur > level))


def crossed_below(prev: Column, cur: Column, level: Column | float) -> Column:
    level = lit(level) if isinstance(level, (int, float)) else level
    return flag((prev >= level) & (cur < level))


def min_max_scale(c: Column, lo: Column, hi: Column) -> Column:
    """Position of a value between two bounds; 0.5 where the bounds coincide."""
    return F.when(F.abs(hi - lo) < EPS, lit(0.5)).otherwise((c - lo) / (hi - lo))


def share(part: Column, whole: Column, default: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(lit(default))


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)
