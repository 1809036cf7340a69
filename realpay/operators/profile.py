"""Data-quality profiles: missing values, describe, mixed describe, value counts.

Each report is one aggregation pass over the input (plus the quantile plan
for describe), never a loop of actions per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from realpay.functions.rounding import round_half_even
from realpay.operators.quantiles import PROB, VALUE, exact_quantiles
from realpay.operators.selection import Summary, column_summaries, local_frame

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)

# Pandas describe() quartile labels.
QUARTILES = ((0.25, "25%"), (0.5, "50%"), (0.75, "75%"))


def _is_numeric(dtype) -> bool:
    return isinstance(dtype, _NUMERIC)


def is_missing(df: DataFrame, name: str):
    c = F.col(f"`{name}`")
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_profile(df: DataFrame, with_pct: bool = True, scale: int = 2) -> DataFrame:
    """One row per column: ``column, missing[, percentage]``.

    ``percentage = round(missing / rows * 100, scale)`` with pandas' half-even
    rounding. NaN counts as missing, as in pandas ``isnull``.
    """
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(is_missing(df, c)).alias(f"__m{i}") for i, c in enumerate(cols)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                                 F.col(f"__m{i}").alias("missing"))
                        for i, c in enumerate(cols)])
    return missing_rows(agg.select("__rows", F.inline(entries)), with_pct, scale)


def missing_rows(long: DataFrame, with_pct: bool = True, scale: int = 2) -> DataFrame:
    """``column, missing[, percentage]`` from counts ``column, missing, __rows``."""
    out = [F.col("column"), F.col("missing")]
    if with_pct:
        pct = F.try_divide(F.col("missing").cast("double"), F.col("__rows").cast("double")) * F.lit(100.0)
        out.append(round_half_even(pct, scale).alias("percentage"))
    return long.select(*out)


def describe_numeric(df: DataFrame, value: str, scale: int = 2, method: str = "exact") -> DataFrame:
    """pandas ``Series.describe().round(scale)`` as ``stat, value`` rows.

    Quartiles are exact (linear rule), not ``df.summary()``'s approximate
    ones; ``std`` of a single value is NULL. All comes from the passes of the
    exact order statistics, run now: the first one also merges the moments.
    ``method="approx"`` takes approximate quartiles and is lazy.
    """
    if method == "exact":
        return described(df.sparkSession, column_summaries(df, [value], [p for p, _ in QUARTILES])[0], scale)
    v = F.col(value).cast("double")
    clean = df.select(v.alias(value)).where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    moments = clean.agg(
        F.count(F.lit(1)).cast("double").alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    cells = [F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in ("count", "mean", "std", "min", "max")]
    labels = F.create_map(*[x for p, name in QUARTILES for x in (F.lit(p), F.lit(name))])
    quart = exact_quantiles(clean, value, [p for p, _ in QUARTILES], method=method)
    long = moments.select(F.inline(F.array(*cells))).unionByName(
        quart.select(labels[F.col(PROB)].alias("stat"), F.col(VALUE).alias("value")))
    return long.select("stat", round_half_even("value", scale).alias("value"))


def described(spark, found: Summary, scale: int = 2) -> DataFrame:
    """The rows of ``describe`` from a column's summary."""
    stats = {"count": float(found.n), "mean": found.mean, "std": found.std, "min": found.least,
             **{name: q for (_, name), q in zip(QUARTILES, found.quantiles)}, "max": found.most}
    rows = [{"stat": name, "value": value} for name, value in stats.items()]
    long = local_frame(spark, rows, T.StructType([T.StructField("stat", T.StringType()), T.StructField("value", T.DoubleType())]))
    return long.select("stat", round_half_even("value", scale).alias("value"))


def category_counts(df: DataFrame, column: str, count_name: str = "count") -> DataFrame:
    """pandas ``value_counts()``: NULL dropped, most frequent first, ties by value."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
              .agg(F.count(F.lit(1)).alias(count_name))
              .orderBy(F.desc(count_name), F.asc(column)))


def describe_all(df: DataFrame, scale: int = 2, columns: Sequence[str] | None = None) -> DataFrame:
    """pandas ``describe(include='all').round(scale)``, one row per column:
    ``column, count, unique, top, freq, mean, std, min, q25, q50, q75, max``.

    Numeric columns fill the moment and quartile cells, other columns
    ``unique/top/freq`` (``top`` ties go to the smallest value, a fixed rule
    where pandas keeps first-seen order). ``count`` is the non-null count.

    NaN is missing, as NULL is. Plan: moments and quartiles of all numeric
    columns in the same passes, run now; one ``(column, value)`` count of the other columns, whose
    summary gives unique, top and freq (a hot value is combined map-side).
    """
    names = list(columns) if columns else df.columns
    fields = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in names if _is_numeric(fields[c])]
    other = [c for c in names if not _is_numeric(fields[c])]
    parts = []
    if numeric:
        cells = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
        rows = [dict(zip(["column", *cells], (c, x.n, x.mean, x.std, x.least, *x.quantiles, x.most)))
                for c, x in zip(numeric, column_summaries(df, numeric, [p for p, _ in QUARTILES]))]
        parts.append(local_frame(df.sparkSession, rows, T.StructType([T.StructField("column", T.StringType()), T.StructField("count", T.LongType()),
                                                                      *(T.StructField(c, T.DoubleType()) for c in cells[1:])])))
    if other:
        long = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v"))
            for c in other]))).where(F.col("v").isNotNull())
        freq = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        summary = freq.groupBy("column").agg(
            F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
            F.min_by("v", F.struct((-F.col("n")).alias("neg_n"), F.col("v").alias("v"))).alias("top"),
            F.max("n").alias("freq"))
        # columns with no non-null value still get a row (count 0)
        present = df.sparkSession.createDataFrame([(c,) for c in other], "column string")
        parts.append(present.join(summary, "column", "left")
                     .select("column", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
                             F.coalesce("unique", F.lit(0)).cast("bigint").alias("unique"), "top",
                             F.col("freq").cast("bigint").alias("freq")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    stats = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    for s in ("unique", "freq"):
        if s not in out.columns:
            out = out.withColumn(s, F.lit(None).cast("bigint"))
    if "top" not in out.columns:
        out = out.withColumn("top", F.lit(None).cast("string"))
    for s in stats:
        if s not in out.columns:
            out = out.withColumn(s, F.lit(None).cast("double"))
    return out.select("column", F.col("count").cast("bigint").alias("count"), "unique", "top", "freq",
                      *[round_half_even(s, scale).alias(s) for s in stats])
