"""IQR fences, outlier rows, inlier filter and box-plot statistics.

Global fences are two numbers from exact order statistics; the row filter gets them as literals, so it stays a
plain ``Filter`` in the scan stage. NaN is a missing value: it lies neither inside nor outside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realpay.constants import IQR_MULTIPLIER
from realpay.functions.numbers import nan_to_null
from realpay.operators.quantiles import quantile_row
from realpay.operators.selection import broadcast_if_small, fenced_groups, global_quantiles

LOW, HIGH = "low_fence", "high_fence"


def iqr_fences(df: DataFrame, value: str, k: float = IQR_MULTIPLIER, method: str = "exact") -> DataFrame:
    """One row: ``q1, q3, iqr, low_fence, high_fence`` over the whole column
    (``Q1 - k*IQR``, ``Q3 + k*IQR``, in that float order)."""
    q = quantile_row(df, value, [0.25, 0.75], method=method, names=["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", iqr.alias("iqr"),
                    (F.col("q1") - F.lit(float(k)) * iqr).alias(LOW),
                    (F.col("q3") + F.lit(float(k)) * iqr).alias(HIGH))


def _fence_columns(df: DataFrame, value: str, k: float, method: str):
    if method == "exact":
        q1, q3 = global_quantiles(df, value, [0.25, 0.75])
        lo, hi = (None, None) if q1 is None else (q1 - float(k) * (q3 - q1), q3 + float(k) * (q3 - q1))
    else:
        row = iqr_fences(df, value, k, method).first()
        lo, hi = row[LOW], row[HIGH]
    return F.lit(lo).cast("double"), F.lit(hi).cast("double")


def iqr_outliers(df: DataFrame, value: str, k: float = IQR_MULTIPLIER, method: str = "exact") -> DataFrame:
    """Rows strictly outside the fences (``v < low or v > high``)."""
    lo, hi = _fence_columns(df, value, k, method)
    v = nan_to_null(F.col(value).cast("double"))
    return df.where((v < lo) | (v > hi))


def iqr_filter(df: DataFrame, value: str, k: float = IQR_MULTIPLIER, method: str = "exact") -> DataFrame:
    """Rows inside the fences, bounds included (``low <= v <= high``)."""
    lo, hi = _fence_columns(df, value, k, method)
    v = nan_to_null(F.col(value).cast("double"))
    return df.where((v >= lo) & (v <= hi))


def box_stats(df: DataFrame, group: str, value: str, k: float = IQR_MULTIPLIER) -> DataFrame:
    """Box-plot data per group: ``group, q25, q50, q75, lo_whisker,
    hi_whisker, n_outliers``.

    Quartiles use the linear rule; whiskers are the most extreme values
    inside the per-group fences; NULL groups and missing values are left out.

    The fences, a row per group, are joined to the rows: of few groups the driver has them and sends them; else they are
    stored, broadcast while their bytes are few, else joined as Spark plans it (AQE splits a hot group). Whiskers and outlier counts are partial aggregates per group.
    """
    base = df.where(F.col(group).isNotNull()).select(group, F.col(value).cast("double").alias("__v"))
    base = base.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    q, few = fenced_groups(base, group, "__v", (0.25, 0.5, 0.75))
    q = q.toDF(group, "q25", "q50", "q75")
    iqr = F.col("q75") - F.col("q25")
    fences = q.select("*", (F.col("q25") - F.lit(float(k)) * iqr).alias(LOW), (F.col("q75") + F.lit(float(k)) * iqr).alias(HIGH))
    joined = base.join(F.broadcast(fences) if few else broadcast_if_small(fences.checkpoint(), group), group)
    v = F.col("__v")
    inside = (v >= F.col(LOW)) & (v <= F.col(HIGH))
    return joined.groupBy(group).agg(
        F.first("q25").alias("q25"), F.first("q50").alias("q50"), F.first("q75").alias("q75"),
        F.min(F.when(inside, v)).alias("lo_whisker"), F.max(F.when(inside, v)).alias("hi_whisker"),
        F.count_if(~inside).alias("n_outliers"))
