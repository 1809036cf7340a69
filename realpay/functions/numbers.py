"""Numeric coercion and clamping with pandas-compatible NULL handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted number syntax, mirroring pandas ``to_numeric``:
# optional sign, digits with an optional fraction or a bare fraction, optional
# exponent, or inf/infinity; surrounding blanks allowed. Anything else
# (``'n/a'``, ``''``, ``'1.0f'``, ``'1d'``) is not a number.
NUMBER_PATTERN = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def nan_to_null(x) -> Column:
    """NaN becomes NULL (the library has one missing-value concept: NULL)."""
    c = _as_col(x)
    return F.when(~F.isnan(c), c)


def strict_number(x) -> Column:
    """``pd.to_numeric(errors='coerce')`` for a string or numeric column.

    Strings are parsed only if they match :data:`NUMBER_PATTERN` (Spark's
    ``try_cast`` alone would accept ``'1.0f'`` and ``'1d'``). ``'inf'`` is
    accepted and becomes infinity, as in pandas; ``'nan'`` becomes NULL.
    Numeric input is cast to double with NaN turned into NULL.
    """
    c = _as_col(x)
    s = c.cast("string")
    parsed = F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))
    return nan_to_null(parsed)


def clamp(x, lo: float, hi: float) -> Column:
    """``max(lo, min(x, hi))`` that keeps NULL as NULL.

    ``greatest``/``least`` skip NULL arguments, so an unguarded clamp would
    turn a missing value into ``lo`` or ``hi``; the guard prevents that.
    """
    c = _as_col(x)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(c, F.lit(float(hi)))))
