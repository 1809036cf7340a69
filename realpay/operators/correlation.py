"""Pairwise Pearson correlation matrix (pandas ``DataFrame.corr``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realpay.functions.rounding import round_half_even


def _pair_corr(a, b):
    """Correlation over rows where both are present.

    ``F.corr`` divides by zero (an error under ANSI) for a constant column;
    here the same quantity is ``covar_samp / (std_a * std_b)`` with both
    standard deviations taken over the pairwise-complete rows, and a zero
    denominator gives NULL.
    """
    both = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    ap, bp = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_samp(ap, bp), F.stddev_samp(ap) * F.stddev_samp(bp))


def corr_matrix(df: DataFrame, columns: Sequence[str], scale: int | None = 2) -> DataFrame:
    """Long matrix ``col_x, col_y, corr`` (k*k rows) from ONE aggregation pass.

    Only the k(k-1)/2 distinct pairs and the k diagonal cells are computed;
    the matrix is symmetric. Values are rounded half-to-even when ``scale``
    is given (pandas ``round``).
    """
    cols = list(columns)
    aggs, cells = [], []
    for i, x in enumerate(cols):
        for j, y in enumerate(cols):
            if j < i:
                continue
            name = f"__c{i}_{j}"
            aggs.append(_pair_corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(name))
    row = df.agg(*aggs)
    for i, x in enumerate(cols):
        for j, y in enumerate(cols):
            a, b = (i, j) if i <= j else (j, i)
            cells.append(F.struct(F.lit(x).alias("col_x"), F.lit(y).alias("col_y"),
                                  F.col(f"__c{a}_{b}").alias("corr")))
    long = row.select(F.inline(F.array(*cells)))
    if scale is not None:
        long = long.select("col_x", "col_y", round_half_even("corr", scale).alias("corr"))
    return long
