"""The report's queries, one per key: ``(spark, sf_dir) -> DataFrame``.

Each query reads the given tables through the fixture builders, so its work
grows with the data. Computed doubles that the report leaves unrounded
(monthly means and growth) are given at 4 decimals so two engines that sum in
a different order print the same digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from realpay.constants import CORR_COLUMNS, SAMPLE_ROWS, SKILL_SEPARATOR, TOP_K
from realpay.functions.rounding import round_half_even
from realpay.operators.correlation import corr_matrix
from realpay.operators.grouping import group_means, top_tokens
from realpay.operators.outliers import box_stats, iqr_outliers
from realpay.operators.profile import category_counts, describe_all, describe_numeric, missing_profile
from realpay.operators.selection import quantile_frame
from realpay.operators.trends import month_label, monthly_trend
from realpay.plans.ppp import merge_costs, ppp_frame, ppp_inliers, rank_by_ppp
from realpay.plans.quality import optional_columns, quality_frame
from realpay.session import configure
from realpay.sources import fixtures
from realpay.sources.csv import infer_types, read_table, tokens_to_null
from realpay.sources.tables import sql_over
from realpay.store import Store

Query = Callable[[SparkSession, str], DataFrame]

TREND_SCALE = 4
#: Counters of the frequent-item summary of :func:`q_top_names`.
NAME_COUNTERS = 16_384


def _jobs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Postings with the wanted columns only (all without any): tables that these don't need are not joined."""
    configure(spark)
    return fixtures.jobs(spark, sf_dir, columns)


def ppp_salaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with their PPP salary (factors joined from the dimension)."""
    return ppp_frame(_jobs(spark, sf_dir), fixtures.cost_living(spark, sf_dir))


def _merged(spark: SparkSession, sf_dir: str, before=lambda jobs: jobs) -> DataFrame:
    """The postings (with their month label, as the report adds it before the
    merge) left-joined to the cost dimension."""
    jobs = _jobs(spark, sf_dir)
    jobs = jobs.withColumn("month", month_label("posting_date", jobs.schema["posting_date"].dataType))
    return merge_costs(before(jobs), fixtures.cost_living(spark, sf_dir))


def q_missing_profile(spark, sf_dir):
    return missing_profile(_jobs(spark, sf_dir), with_pct=True)


def q_col_missing_profile(spark, sf_dir):
    configure(spark)
    return missing_profile(fixtures.city_costs(spark, sf_dir), with_pct=False)


def q_salary_describe(spark, sf_dir):
    return describe_numeric(_jobs(spark, sf_dir, "salary_usd"), "salary_usd")


def q_col_describe_all(spark, sf_dir):
    configure(spark)
    return describe_all(fixtures.city_costs(spark, sf_dir))


def q_quantiles(spark, sf_dir):
    return quantile_frame(_jobs(spark, sf_dir, "salary_usd"), "salary_usd", [0.25, 0.75])


def q_iqr_outliers(spark, sf_dir):
    return iqr_outliers(_jobs(spark, sf_dir, "job_id", "salary_usd"), "salary_usd")


def q_experience_counts(spark, sf_dir):
    return category_counts(_jobs(spark, sf_dir, "experience_level"), "experience_level")


def q_corr_matrix(spark, sf_dir):
    return corr_matrix(_jobs(spark, sf_dir, *CORR_COLUMNS), CORR_COLUMNS)


def q_salary_box_stats(spark, sf_dir):
    return box_stats(_jobs(spark, sf_dir, "experience_level", "salary_usd"), "experience_level", "salary_usd")


def _trend(jobs: DataFrame) -> DataFrame:
    out = monthly_trend(jobs, "posting_date", "job_id",
                        {"avg_salary": "salary_usd", "avg_years_experience": "years_experience"},
                        growth={"job_growth": "job_count", "salary_growth": "avg_salary"})
    rounded = ("avg_salary", "avg_years_experience", "job_growth", "salary_growth")
    return out.select("month", "job_count", *[round_half_even(c, TREND_SCALE).alias(c) for c in rounded])


def q_monthly_trend(spark, sf_dir):
    return _trend(_jobs(spark, sf_dir, "job_id", "posting_date", "salary_usd", "years_experience"))


def q_monthly_trend_text(spark, sf_dir):
    """The same from dates that come as text."""
    jobs = _jobs(spark, sf_dir, "job_id", "posting_date", "salary_usd", "years_experience")
    return _trend(jobs.withColumn("posting_date", F.date_format("posting_date", "yyyy-MM-dd")))


def q_top_skills(spark, sf_dir):
    configure(spark)
    return top_tokens(fixtures.skills(spark, sf_dir), "required_skills", SKILL_SEPARATOR, k=TOP_K)


def q_top_names(spark, sf_dir):
    """Tokens of a vocabulary that grows with the data, of which a few are frequent."""
    configure(spark)
    return top_tokens(fixtures.name_lists(spark, sf_dir), "names", SKILL_SEPARATOR, k=TOP_K, token_name="name", summary=NAME_COUNTERS)


def q_remote_stats(spark, sf_dir):
    return group_means(_jobs(spark, sf_dir, "remote_ratio", "salary_usd"), "remote_ratio", {"avg_salary": "salary_usd"},
                       "job_count", order_by="remote_ratio")


def q_geo_top10(spark, sf_dir):
    return group_means(_jobs(spark, sf_dir, "company_location", "salary_usd", "remote_ratio"), "company_location",
                       {"avg_salary": "salary_usd", "avg_remote_ratio": "remote_ratio"}, "job_count",
                       order_by="avg_salary", descending=True, k=TOP_K,
                       columns_order=["company_location", "avg_salary", "job_count", "avg_remote_ratio"])


def q_col_join(spark, sf_dir):
    return _merged(spark, sf_dir)


def q_merged_sample(spark, sf_dir):
    # a left join keeps every posting: the first rows of the join come from the first postings
    def first(df):
        return df.orderBy(F.asc_nulls_last("job_id")).limit(SAMPLE_ROWS)

    return first(_merged(spark, sf_dir, first))


PPP_COLUMNS = ("job_id", "company_location", "salary_usd", "col_index", "col_plus_rent", "lpp",
               "weighted_col", "clamped_lpp", "ppp_salary")


def q_ppp_salary(spark, sf_dir):
    return ppp_salaries(spark, sf_dir).select(*PPP_COLUMNS)


INLIER_COLUMNS = ("job_id", "company_location", "salary_usd", "ppp_salary")


def q_iqr_filter(spark, sf_dir):
    return ppp_inliers(ppp_salaries(spark, sf_dir), columns=INLIER_COLUMNS)


def q_ppp_describe(spark, sf_dir):
    return describe_numeric(ppp_inliers(ppp_salaries(spark, sf_dir), columns=["ppp_salary"]), "ppp_salary")


def q_ppp_country_ranking(spark, sf_dir):
    return rank_by_ppp(ppp_inliers(ppp_salaries(spark, sf_dir),
                                   columns=["company_location", "salary_usd", "ppp_salary"]))


def q_csv_na_tokens(spark, sf_dir):
    """Missing-value tokens and inferred types of the cost table's text columns."""
    configure(spark)
    costs = fixtures.city_costs(spark, sf_dir)
    text = costs.select(*[tokens_to_null(F.col(f"`{c}`")).alias(c) for c, t in costs.dtypes if t == "string"])
    types = {f.name: f.dataType.simpleString() for f in infer_types(text)}
    named = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return missing_profile(text, with_pct=False).select("column", named[F.col("column")].alias("type"), "missing")


def q_csv_scan(spark, sf_dir):
    """The cost table written as CSV files into the shared folder and read again, its types inferred."""
    configure(spark)
    path = Store(spark).path("city_costs_csv")
    fixtures.city_costs(spark, sf_dir).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_table(spark, path)


def q_sql_remote(spark, sf_dir):
    """A frame queried with SQL under a name that only the query knows."""
    return sql_over(spark, "SELECT remote_ratio, count(*) AS job_count, min(salary_usd) AS least, max(salary_usd) AS most "
                    "FROM {postings} GROUP BY remote_ratio", postings=_jobs(spark, sf_dir, "remote_ratio", "salary_usd"))


def q_optional_columns(spark, sf_dir):
    return optional_columns(_jobs(spark, sf_dir, "experience_level", "salary_usd"), ["salary_usd", "experience_level", "bonus_usd"])


def q_quality_report(spark, sf_dir):
    return quality_frame(_jobs(spark, sf_dir, "job_id", "salary_usd", "experience_level", "remote_ratio"))


QUERIES: dict[str, Query] = {
    "missing_profile": q_missing_profile,
    "col_missing_profile": q_col_missing_profile,
    "salary_describe": q_salary_describe,
    "ppp_describe": q_ppp_describe,
    "col_describe_all": q_col_describe_all,
    "quantiles": q_quantiles,
    "iqr_outliers": q_iqr_outliers,
    "iqr_filter": q_iqr_filter,
    "experience_counts": q_experience_counts,
    "corr_matrix": q_corr_matrix,
    "salary_box_stats": q_salary_box_stats,
    "monthly_trend": q_monthly_trend,
    "top_skills": q_top_skills,
    "top_names": q_top_names,
    "remote_stats": q_remote_stats,
    "geo_top10": q_geo_top10,
    "col_join": q_col_join,
    "merged_sample": q_merged_sample,
    "ppp_salary": q_ppp_salary,
    "ppp_country_ranking": q_ppp_country_ranking,
    "monthly_trend_text": q_monthly_trend_text,
    "csv_na_tokens": q_csv_na_tokens,
    "csv_scan": q_csv_scan,
    "sql_remote": q_sql_remote,
    "optional_columns": q_optional_columns,
    "quality_report": q_quality_report,
}
