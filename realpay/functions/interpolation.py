"""Linear interpolation between order statistics, bit-for-bit as SQL's
``quantile_cont`` computes it.

With ``h = (n - 1) * p``, ``d = h - floor(h)`` and neighbours ``lo``/``hi``,
the engine evaluates ``lo * (1 - d) + hi * d`` as one fused multiply-add,
``fma(lo, 1 - d, hi * d)`` (one rounding of ``lo * (1 - d) + round(hi * d)``).
The real-number value is the same as pandas' and Spark's ``percentile``; the
last bit can differ, so the rule is fixed here.

Spark SQL has no fused multiply-add, so :func:`fma` rebuilds it from plain
double operations: Dekker's exact product (Veltkamp splitting) and Knuth's
exact sum, then one final addition of the error terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Veltkamp splitter for doubles, 2**27 + 1.
_SPLIT = 134217729.0
# Above this magnitude the split could overflow; plain arithmetic is used.
_SAFE = 1e290


def _split(a: Column):
    c = F.lit(_SPLIT) * a
    hi = c - (c - a)
    return hi, a - hi


def fma(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` with a single rounding (emulated, double arithmetic)."""
    p = a * b
    ah, al = _split(a)
    bh, bl = _split(b)
    e = ((ah * bh - p) + ah * bl + al * bh) + al * bl   # a*b == p + e exactly
    s = p + c
    z = s - p
    es = (p - (s - z)) + (c - z)                         # p + c == s + es exactly
    exact = s + (es + e)
    safe = (F.abs(a) < F.lit(_SAFE)) & (F.abs(b) < F.lit(_SAFE)) & (F.abs(c) < F.lit(_SAFE))
    return F.when(safe, exact).otherwise(a * b + c)


def lerp(lo: Column, hi: Column, d: Column) -> Column:
    """``fma(lo, 1 - d, hi * d)`` as a column expression."""
    return fma(lo, F.lit(1.0) - d, hi * d)


def lerp_value(lo: float, hi: float, d: float) -> float:
    """The same rule on the driver (Python has a true ``fma``)."""
    return math.fma(lo, 1.0 - d, hi * d)
