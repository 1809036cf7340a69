"""Data-quality report over a postings table: missing values, salary statistics, IQR outliers, experience levels.

Columns that are absent are skipped when the plan is built, like the report's ``if column in df.columns`` guards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realpay.constants import IQR_MULTIPLIER
from realpay.functions.numbers import nan_to_null
from realpay.operators.materialize import materialize
from realpay.operators.profile import QUARTILES, described, is_missing, missing_rows
from realpay.operators.selection import column_summaries, first_bins, merged_bins


def quality_report(jobs: DataFrame, salary: str = "salary_usd", category: str = "experience_level") -> dict[str, DataFrame]:
    """Frames ``missing``, ``salary_stats``, ``salary_outliers`` (the rows) and ``category_counts``, as far as columns are there.

    One scan counts all of it: rows are grouped by category and by the bin that the exact quartiles begin with, and
    each group keeps its missing values, salary moments and extremes. The stored result, a row per category and
    bin, gives every section; only the rows of the quartiles' own bins are read once more.
    """
    has_salary, has_category = salary in jobs.columns, category in jobs.columns
    value = nan_to_null(F.col(salary).cast("double")) if has_salary else F.lit(None).cast("double")
    bin_, kept = first_bins(value)
    level = F.col(category) if has_category else F.lit(None).cast("string")
    missing = [F.count_if(is_missing(jobs, c)).alias(f"m{i}") for i, c in enumerate(jobs.columns)]
    cube = materialize(jobs.groupBy(level.alias("level"), bin_).agg(F.count(F.lit(1)).alias("rows"), *kept, *missing))

    sums = cube.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("__rows"), *[F.coalesce(F.sum(f"m{i}"), F.lit(0)).alias(f"m{i}") for i in range(len(jobs.columns))])
    counts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(jobs.columns)])
    report = {"missing": missing_rows(sums.select("__rows", F.inline(counts)))}
    if has_salary:
        bins = merged_bins(cube.select(F.lit(0).alias("g"), "bin", "c", "lo", "hi", "m", "s"))
        found = column_summaries(jobs, [salary], [p for p, _ in QUARTILES], bins=bins)[0]
        report["salary_stats"] = described(jobs.sparkSession, found)
        low, _, high = found.quantiles
        fences = (None, None) if low is None else (low - IQR_MULTIPLIER * (high - low), high + IQR_MULTIPLIER * (high - low))
        report["salary_outliers"] = jobs.where((value < F.lit(fences[0]).cast("double")) | (value > F.lit(fences[1]).cast("double")))
    if has_category:
        own = cube.where("level IS NOT NULL").groupBy(F.col("level").alias(category)).agg(F.sum("rows").alias("count"))
        report["category_counts"] = own.orderBy(F.desc("count"), F.asc(category))
    return report


def quality_frame(jobs: DataFrame, salary: str = "salary_usd", category: str = "experience_level") -> DataFrame:
    """The report as one frame ``section, name, value``; of the outliers, their number."""
    parts = quality_report(jobs, salary, category)
    rows = {
        "missing": lambda d: d.select("column", F.col("missing").cast("double")),
        "salary_stats": lambda d: d.select("stat", "value"),
        "salary_outliers": lambda d: d.agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit("rows"), "n"),
        "category_counts": lambda d: d.select(category, F.col("count").cast("double")),
    }
    out = None
    for section, df in parts.items():
        own = rows[section](df).toDF("name", "value").select(F.lit(section).alias("section"), "name", "value")
        out = own if out is None else out.unionByName(own)
    return out


def optional_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``column, present, non_null`` for each of ``names``: NULL counts for a column that is not there."""
    there = [n for n in names if n in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{n}`")).alias(f"n{i}") for i, n in enumerate(there)])
    cells = [F.struct(F.lit(n).alias("column"), F.lit(n in there).alias("present"),
                      (F.col(f"n{there.index(n)}") if n in there else F.lit(None)).cast("bigint").alias("non_null")) for n in names]
    return counts.select(F.inline(F.array(*cells)))
