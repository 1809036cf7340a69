"""Results do not depend on the physical layout: many small input splits and
many shuffle partitions (a wide cluster in miniature) give the same exact
answers as the oracle."""

import pytest

from tests.oracle_check import compare, duck

KEYS = ["quantiles", "salary_describe", "salary_box_stats", "col_describe_all", "iqr_outliers",
        "ppp_country_ranking", "top_skills", "monthly_trend"]

WIDE = {
    "spark.sql.files.maxPartitionBytes": "32k",
    "spark.sql.files.openCostInBytes": "1k",
    "spark.sql.shuffle.partitions": "37",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture(scope="module")
def wide(spark):
    old = {k: spark.conf.get(k, None) for k in WIDE}
    for k, v in WIDE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("key", KEYS)
def test_wide_layout_matches_oracle(wide, con, key):
    ok, msg = compare(wide, key, con=con)
    assert ok, msg
