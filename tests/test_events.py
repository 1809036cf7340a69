"""Quantile and IQR operators on a second real column (events.value) against
DuckDB directly."""

import pytest

from realpay.operators import exact_quantiles, global_quantiles, iqr_filter, iqr_outliers
from realpay.sources.tables import load_table
from tests.conftest import SF01
from tests.oracle_check import duck


@pytest.fixture(scope="module")
def events(spark):
    return load_table(spark, SF01, "events")


def test_events_quantiles_and_fences(events):
    con = duck()
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    expect = [con.execute(f"SELECT quantile_cont(value, {p}) FROM events").fetchone()[0] for p in probs]
    assert global_quantiles(events, "value", probs) == expect
    long = {r["prob"]: r["value"] for r in exact_quantiles(events, "value", probs).collect()}
    assert [long[p] for p in probs] == expect
    n_out = con.execute("""WITH f AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events)
        SELECT count(*) FROM events, f WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""").fetchone()[0]
    assert n_out == 463
    assert iqr_outliers(events, "value").count() == n_out
    assert iqr_filter(events, "value").count() + n_out == events.count()


def test_events_grouped_by_type(events):
    con = duck()
    rows = con.execute("""SELECT event_type, quantile_cont(value, 0.5) FROM events GROUP BY event_type""").fetchall()
    from realpay.operators import grouped_quantiles
    got = grouped_quantiles(events, "event_type", "value", [0.5])
    assert {r["event_type"]: r["q0"] for r in got.collect()} == dict(rows)
