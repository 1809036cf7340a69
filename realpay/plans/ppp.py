"""Purchasing-power flow: join costs, derive PPP salary, drop outliers, rank.

The left join meets the cost dimension (which Spark broadcasts by its size) with its PPP
factors precomputed, so the PPP salary is one expression in the scan's codegen
stage; the PPP population is stored once (reliable checkpoint) because the
IQR fences and the filter both read it; the fences come from the exact
selection as two literals; the ranking is a partial/final aggregate followed
by ``TakeOrderedAndProject``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realpay.functions.numbers import clamp, strict_number
from realpay.functions.ppp import LPP_BOUNDS, ppp_salary, weighted_index
from realpay.functions.rounding import round_half_away
from realpay.functions.text import normalize_key
from realpay.operators.joins import join_dimension
from realpay.operators.materialize import materialize
from realpay.operators.outliers import iqr_filter
from realpay.constants import IQR_MULTIPLIER, MERGED_COLUMNS, MIN_JOBS, TOP_K

COST_COLUMNS = MERGED_COLUMNS


def merge_costs(jobs: DataFrame, costs: DataFrame, location: str = "company_location",
                country: str = "Country") -> DataFrame:
    """Every posting with the three raw cost indices of its (trimmed) country."""
    return join_dimension(jobs, costs, location, country, COST_COLUMNS)


def with_ppp(merged: DataFrame, salary: str = "salary_usd") -> DataFrame:
    """Coerce the indices of an already merged frame to numbers and add
    ``weighted_col``, ``clamped_lpp`` and ``ppp_salary`` (same rows)."""
    out = merged.withColumns({c: strict_number(c) for c in COST_COLUMNS})
    out = out.withColumns({
        "weighted_col": weighted_index("col_index", "col_plus_rent"),
        "clamped_lpp": clamp("lpp", *LPP_BOUNDS),
    })
    return out.withColumn("ppp_salary", ppp_salary(salary, "clamped_lpp", "weighted_col"))


def cost_factors(costs: DataFrame, country: str = "Country") -> DataFrame:
    """The dimension with its PPP factors precomputed, one row per country:
    ``Country, col_index, col_plus_rent, lpp`` (numbers) plus
    ``weighted_col`` and ``clamped_lpp``.

    These depend on dimension columns only, so computing them before the join
    costs one evaluation per country instead of one per posting; an
    unmatched posting still gets NULL for all of them, as after the join.
    """
    num = costs.select(F.col(f"`{country}`").alias(country),
                       *[strict_number(F.col(f"`{src}`")).alias(alias) for alias, src in COST_COLUMNS.items()])
    return num.withColumns({
        "weighted_col": weighted_index("col_index", "col_plus_rent"),
        "clamped_lpp": clamp("lpp", *LPP_BOUNDS),
    })


FACTOR_COLUMNS = ("col_index", "col_plus_rent", "lpp", "weighted_col", "clamped_lpp")


def ppp_frame(jobs: DataFrame, costs: DataFrame, location: str = "company_location",
              country: str = "Country", salary: str = "salary_usd") -> DataFrame:
    """Postings with coerced indices, ``weighted_col``, ``clamped_lpp`` and
    ``ppp_salary``; equal to ``with_ppp(merge_costs(jobs, costs))`` but the
    factors are joined precomputed from the (broadcast) dimension."""
    merged = join_dimension(jobs, cost_factors(costs, country), location, country,
                            {c: c for c in FACTOR_COLUMNS})
    return merged.withColumn("ppp_salary", ppp_salary(salary, "clamped_lpp", "weighted_col"))


def ppp_population(with_salary: DataFrame) -> DataFrame:
    """Rows that have a PPP salary (``dropna(subset=['ppp_salary'])``)."""
    return with_salary.where(F.col("ppp_salary").isNotNull() & ~F.isnan("ppp_salary"))


def ppp_inliers(with_salary: DataFrame, k: float = IQR_MULTIPLIER, columns=None,
                stored: bool = True) -> DataFrame:
    """PPP rows inside the global IQR fences of ``ppp_salary`` (inclusive).

    The PPP population (narrowed to ``columns`` when given) is read twice —
    by the fence computation and by the filter — so by default it is stored
    once as a reliable checkpoint and both read the stored rows.
    """
    pop = ppp_population(with_salary)
    if stored:
        pop = materialize(pop, columns)
    elif columns:
        pop = pop.select(*columns)
    return iqr_filter(pop, "ppp_salary", k)


def rank_by_ppp(final: DataFrame, key: str = "company_location", salary: str = "salary_usd",
                min_jobs: int = MIN_JOBS, k: int = TOP_K, normalize: bool = False) -> DataFrame:
    """Countries by average PPP salary: at least ``min_jobs`` postings (after
    outlier removal), averages rounded like SQL ``ROUND``, sorted by the
    rounded value, ties by country, top ``k``. The raw (untrimmed) location
    is the group key, as in the report; ``normalize=True`` groups by the
    trimmed location instead, so padded spellings of a country merge."""
    if normalize:
        final = final.withColumn(key, normalize_key(key))
    agg = (final.groupBy(key)
                .agg(F.avg(salary).alias("avg_nominal"), F.avg("ppp_salary").alias("avg_ppp"),
                     F.count(F.lit(1)).alias("job_count"))
                .where(F.col("job_count") >= min_jobs))
    out = agg.select(key, round_half_away("avg_nominal", 2).alias("avg_nominal_salary"),
                     round_half_away("avg_ppp", 2).alias("avg_ppp_salary"), "job_count")
    return out.orderBy(F.desc_nulls_last("avg_ppp_salary"), F.asc_nulls_last(key)).limit(k)
