"""Quantiles per group: exact (:mod:`realpay.operators.selection`) or approximate (one bounded sketch per group)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realpay.operators.selection import global_quantiles, order_statistics

PROB = "prob"
VALUE = "value"


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), method: str = "exact") -> DataFrame:
    """Quantiles of ``value`` per group, long form ``by..., prob, value``.

    NULL and NaN values are skipped; a NULL group key is a group of its own. Groups without values have no rows.
    """
    if method == "approx":
        return approx_quantiles(df, value, probs, by)
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")
    if by:
        return order_statistics(df, value, probs, by)
    found = zip(map(float, probs), global_quantiles(df, value, probs))
    return df.sparkSession.createDataFrame([x for x in found if x[1] is not None], f"{PROB} double, {VALUE} double")


def approx_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), accuracy: int = 10000) -> DataFrame:
    """``percentile_approx`` per group (rank error at most ``n / accuracy``); the same long form."""
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    v = F.col(value).cast("double")
    g = df.select(*by, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v")).groupBy(*by).agg(
        F.percentile_approx("__v", wanted, accuracy).alias("__qs"))
    return (g.select(*by, "__qs", F.posexplode(wanted).alias("__i", PROB))
             .select(*by, PROB, F.element_at(F.col("__qs"), F.col("__i") + 1).alias(VALUE)))


def quantile_row(df: DataFrame, value: str, probs: Sequence[float], method: str = "exact", names: Sequence[str] | None = None) -> DataFrame:
    """Global quantiles as ONE row with a column per probability (names default to ``q<percent>``)."""
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"q{p * 100:g}".replace(".", "_") for p in probs]
    long = exact_quantiles(df, value, probs, method=method)
    return long.agg(*[F.max(F.when(F.col(PROB) == F.lit(p), F.col(VALUE))).alias(n) for p, n in zip(probs, names)])
