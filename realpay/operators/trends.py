"""Monthly aggregates with period-over-period growth (pandas ``pct_change``)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from realpay.functions.numbers import nan_to_null


def month_label(date_col: str, dtype=None, fmt: str = "yyyy-MM") -> Column:
    """``YYYY-MM`` label; strings are parsed as ``yyyy-MM-dd`` (ANSI: a bad
    string raises, as ``pd.to_datetime`` does), timestamps are truncated to
    their date first so no time zone can move them across a month."""
    c = F.col(date_col)
    if isinstance(dtype, T.StringType):
        d = F.to_date(c, "yyyy-MM-dd")
    else:
        d = F.to_date(c)
    return F.date_format(d, fmt)


def monthly_trend(df: DataFrame, date_col: str, id_col: str, means: Mapping[str, str],
                  count_name: str = "job_count", growth: Mapping[str, str] | None = None) -> DataFrame:
    """Per month: ``count(id)`` (non-null ids), means, and growth columns.

    The month group-by is a normal partial/final aggregate; the growth window
    runs on the aggregated rows only (one per month, a few hundred at most),
    so its single ordered partition is bounded by the calendar, not the data.
    Rows without a date are dropped (pandas drops a NaN group key).
    """
    month = month_label(date_col, df.schema[date_col].dataType).alias("month")
    base = df.select(month, F.col(id_col), *[F.col(src) for src in means.values()])
    agg = (base.where(F.col("month").isNotNull()).groupBy("month")
               .agg(F.count(F.col(id_col)).alias(count_name),
                    *[F.avg(nan_to_null(F.col(src).cast("double"))).alias(alias) for alias, src in means.items()]))
    growth = dict(growth or {})
    w = Window.orderBy("month")
    fill = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = agg
    for alias, src in growth.items():
        filled = F.last(F.col(src).cast("double"), ignorenulls=True).over(fill)
        out = out.withColumn(f"__f_{alias}", filled)
        prev = F.lag(F.col(f"__f_{alias}")).over(w)
        out = out.withColumn(alias, (F.try_divide(F.col(f"__f_{alias}"), prev) - F.lit(1.0)) * F.lit(100.0))
    return out.select("month", count_name, *means.keys(), *growth.keys())
