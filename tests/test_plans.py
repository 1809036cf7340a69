"""Physical-plan checks: no Python evaluation, pruned and pushed-down scans,
broadcast join for the dimension, top-k as TakeOrderedAndProject, and no
single-task exact percentile aggregate."""

import pytest

from realpay.plans import catalog
from tests.conftest import SF01

KEYS = sorted(catalog.QUERIES)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _full_plan(df) -> str:
    """Initial physical plan including subqueries (AQE off in explain text)."""
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_python_in_plan(spark, key):
    text = _full_plan(catalog.QUERIES[key](spark, SF01))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF"):
        assert node not in text, (key, node)


@pytest.mark.parametrize("key", ["quantiles", "salary_describe", "ppp_country_ranking", "salary_box_stats",
                                 "col_describe_all"])
def test_no_single_reducer_percentile(spark, key):
    text = _full_plan(catalog.QUERIES[key](spark, SF01))
    assert "percentile(" not in text.lower().replace("percentile_approx", "")


def test_dimension_join_is_broadcast(spark):
    df = catalog.q_col_join(spark, SF01)
    df.count()
    assert "BroadcastHashJoin" in _plan(df)


@pytest.mark.parametrize("key", ["top_skills", "geo_top10", "ppp_country_ranking", "merged_sample"])
def test_topk_is_take_ordered(spark, key):
    text = _full_plan(catalog.QUERIES[key](spark, SF01))
    assert "TakeOrderedAndProject" in text


def test_scans_are_pruned(spark):
    text = _full_plan(catalog.q_remote_stats(spark, SF01))
    orders_schema = [line for line in text.splitlines() if "orders.parquet" in line]
    assert orders_schema, text
    for line in orders_schema:
        assert "o_orderstatus" not in line and "o_clerk" not in line


def test_filters_reach_the_scan(spark):
    from realpay.sources.tables import load_table
    from pyspark.sql import functions as F
    df = load_table(spark, SF01, "orders").where(F.col("o_totalprice") > 1000).select("o_orderkey")
    text = _full_plan(df)
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in text
