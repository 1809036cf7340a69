"""Operators: each takes and returns a DataFrame (see the package notes on
which steps run small jobs when called)."""

from realpay.operators.correlation import corr_matrix
from realpay.operators.grouping import group_means, top_tokens
from realpay.operators.joins import join_dimension
from realpay.operators.outliers import box_stats, iqr_fences, iqr_filter, iqr_outliers
from realpay.operators.profile import category_counts, describe_all, describe_numeric, missing_profile
from realpay.operators.materialize import materialize
from realpay.operators.quantiles import approx_quantiles, exact_quantiles, quantile_row
from realpay.operators.selection import global_quantiles, grouped_quantiles, quantile_frame
from realpay.operators.trends import monthly_trend

__all__ = [
    "approx_quantiles",
    "box_stats",
    "category_counts",
    "corr_matrix",
    "describe_all",
    "describe_numeric",
    "exact_quantiles",
    "global_quantiles",
    "grouped_quantiles",
    "group_means",
    "iqr_fences",
    "iqr_filter",
    "iqr_outliers",
    "join_dimension",
    "materialize",
    "missing_profile",
    "monthly_trend",
    "quantile_frame",
    "quantile_row",
    "top_tokens",
]
