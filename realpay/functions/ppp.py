"""Purchasing-power expressions (weighted cost index, clamped PPP salary)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from realpay.constants import INDEX_BOUNDS, INDEX_WEIGHT, LPP_BOUNDS, MIN_SALARY  # noqa: F401
from realpay.functions.numbers import clamp


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def weighted_index(index, plus_rent, weight: float = INDEX_WEIGHT,
                   lo: float = INDEX_BOUNDS[0], hi: float = INDEX_BOUNDS[1]) -> Column:
    """Blend two cost indices and clamp.

    Both present: ``weight*index + (1-weight)*plus_rent``; one present: that
    one; none: NULL. The result is clamped to ``[lo, hi]``.
    """
    a, b = _as_col(index), _as_col(plus_rent)
    blended = (F.when(a.isNotNull() & b.isNotNull(),
                      F.lit(float(weight)) * a + F.lit(1.0 - float(weight)) * b)
               .otherwise(F.coalesce(a, b)))
    return clamp(blended, lo, hi)


def ppp_salary(salary, clamped_lpp, weighted_col, min_salary: float = MIN_SALARY) -> Column:
    """``salary * (lpp/100) / (weighted/100)``; NULL if a factor is missing or
    the salary is below ``min_salary`` (a NULL salary gives NULL too)."""
    s, lpp, w = _as_col(salary), _as_col(clamped_lpp), _as_col(weighted_col)
    return (F.when(w.isNull() | lpp.isNull(), F.lit(None).cast("double"))
            .when(s < F.lit(float(min_salary)), F.lit(None).cast("double"))
            .otherwise(s * (lpp / F.lit(100.0)) / (w / F.lit(100.0))))
