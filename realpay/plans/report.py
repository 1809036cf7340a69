"""Run the whole report: every section as a DataFrame, optionally stored.

The sections share what is dear to compute: the PPP population (a join) and its inliers (fences over the whole column) are
made once and stored while the report needs them. ``report(spark, sf_dir, store)`` gives the sections' frames, which can be
used until ``store`` is closed; ``run_report`` writes each section as Parquet under ``out_dir/<section>`` (overwritten on
re-runs) and leaves nothing else behind. From a shell::

    python -m realpay.plans.report /path/to/tables [/path/to/output]
"""

from __future__ import annotations

import os
import sys
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from realpay.operators.outliers import iqr_filter
from realpay.operators.profile import describe_numeric
from realpay.plans.catalog import INLIER_COLUMNS, PPP_COLUMNS, QUERIES, ppp_salaries
from realpay.plans.ppp import ppp_population, rank_by_ppp
from realpay.store import Store

# The report's sections, in the order the report presents them.
SECTIONS = (
    "missing_profile", "salary_describe", "quantiles", "iqr_outliers", "experience_counts",
    "corr_matrix", "salary_box_stats", "monthly_trend", "top_skills", "top_names", "remote_stats", "geo_top10",
    "col_missing_profile", "col_describe_all", "col_join", "merged_sample", "ppp_salary",
    "iqr_filter", "ppp_describe", "ppp_country_ranking", "monthly_trend_text", "csv_na_tokens", "csv_scan",
    "sql_remote", "optional_columns", "quality_report",
)


class _Shared:
    """Frames that several sections read, each made when the first one needs it."""

    def __init__(self, spark: SparkSession, sf_dir: str, store: Store):
        self._spark, self._sf_dir, self._store = spark, sf_dir, store

    @cached_property
    def salaries(self) -> DataFrame:
        return self._store.keep(ppp_salaries(self._spark, self._sf_dir).select(*PPP_COLUMNS), "ppp_salary")

    @cached_property
    def inliers(self) -> DataFrame:
        return iqr_filter(ppp_population(self.salaries).select(*INLIER_COLUMNS), "ppp_salary")


_FROM_SHARED = {
    "ppp_salary": lambda shared: shared.salaries,
    "iqr_filter": lambda shared: shared.inliers,
    "ppp_describe": lambda shared: describe_numeric(shared.inliers, "ppp_salary"),
    "ppp_country_ranking": lambda shared: rank_by_ppp(shared.inliers),
}


def report(spark: SparkSession, sf_dir: str, store: Store, sections=SECTIONS):
    """Yield ``name, frame`` section by section."""
    shared = _Shared(spark, sf_dir, store)
    for name in sections:
        yield name, _FROM_SHARED[name](shared) if name in _FROM_SHARED else QUERIES[name](spark, sf_dir)


def run_report(spark: SparkSession, sf_dir: str, out_dir: str, sections=SECTIONS) -> dict[str, DataFrame]:
    """Write every section and return the written tables."""
    results = {}
    with Store(spark) as store:
        for name, df in report(spark, sf_dir, store, sections):
            path = os.path.join(out_dir, name)
            df.write.mode("overwrite").parquet(path)
            results[name] = spark.read.schema(df.schema).parquet(path)
    return results


def main(argv: list[str]) -> int:
    if not argv:
        print(__doc__)
        return 2
    from realpay.session import build_session
    spark = build_session()
    with Store(spark) as store:
        found = run_report(spark, argv[0], argv[1]).items() if len(argv) > 1 else report(spark, argv[0], store)
        for name, df in found:
            print(f"== {name}")
            df.show(10, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
