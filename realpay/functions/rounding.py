"""The two decimal roundings used by the report.

pandas ``Series.round(n)`` rounds half to even on the *scaled binary value*
(``rint(x * 10**n) / 10**n``), while SQL ``ROUND(x, n)`` rounds half away from
zero on the scaled value (``round(x * 10**n) / 10**n``). Spark's own
``F.round(x, n)`` and ``F.bround(x, n)`` round the *decimal string* of ``x``
instead, which gives 1.01 for 1.005 where both engines above give 1.0. So both
helpers scale first and round to an integer, reproducing the engines exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def round_half_even(x, scale: int = 2) -> Column:
    """pandas/numpy ``round``: ``rint(x * 10**scale) / 10**scale``."""
    factor = float(10 ** scale)
    return F.rint(_as_col(x) * F.lit(factor)) / F.lit(factor)


def round_half_away(x, scale: int = 2) -> Column:
    """SQL ``ROUND``: half away from zero on ``x * 10**scale``.

    ``F.round(y, 0)`` on an already scaled double rounds half up (away from
    zero) and agrees with C ``round`` because the shortest decimal form of a
    double never crosses a .5 boundary.
    """
    factor = float(10 ** scale)
    return F.round(_as_col(x) * F.lit(factor), 0) / F.lit(factor)
