"""Every query key equals its DuckDB oracle at sf0.01 and sf0.001 (exact doubles)."""

import pytest

from realpay.plans.catalog import QUERIES
from realpay.plans.oracle import oracle_sql
from tests.conftest import SF001
from tests.oracle_check import compare, duck

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.fixture(scope="module")
def con_small():
    return duck(SF001)


def test_keys_have_oracles():
    assert sorted(oracle_sql()) == KEYS
    assert len(KEYS) == 26


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    ok, msg = compare(spark, key, con=con)
    assert ok, msg


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle_on_smallest_data(spark, con_small, key):
    ok, msg = compare(spark, key, sf_dir=SF001, con=con_small)
    assert ok, msg
