"""Exact order statistics by histograms: equal to numpy on every path."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from realpay.operators import selection as S
from realpay.operators.quantiles import approx_quantiles, exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    n = 40000
    v = rng.lognormal(10, 1, n).round(2)
    v[rng.random(n) < 0.34] = 777.0          # a third of the rows on one value
    v[rng.random(n) < 0.01] = np.nan
    return v[~np.isnan(v)], spark.createDataFrame(pd.DataFrame({"v": v})).repartition(8)


@pytest.fixture
def passes(monkeypatch):
    """Counts the passes over the brackets' rows."""
    seen = []
    real = S._next_bin
    monkeypatch.setattr(S, "_next_bin", lambda *a: seen.append(1) or real(*a))
    return seen


def _expect(vals, probs):
    return [float(np.quantile(vals, p)) for p in probs]


def test_one_histogram_is_enough_for_small_columns(data, passes):
    vals, df = data
    assert S.global_quantiles(df, "v", PROBS) == pytest.approx(_expect(vals, PROBS), rel=1e-12)
    assert not passes


def test_brackets_narrow(data, passes, monkeypatch):
    vals, df = data
    monkeypatch.setattr(S, "FEW_ROWS", 3)
    assert S.global_quantiles(df, "v", PROBS) == pytest.approx(_expect(vals, PROBS), rel=1e-12)
    assert 1 <= len(passes) <= 6


def test_a_hot_value_ends_its_bracket(spark, passes, monkeypatch):
    """80 % equal values: two passes at most, however small the bound."""
    monkeypatch.setattr(S, "FEW_ROWS", 100)
    rng = np.random.default_rng(4)
    vals = np.where(rng.random(20000) < 0.8, 50000.0, rng.uniform(20000, 90000, 20000))
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    assert S.global_quantiles(df, "v", [0.25, 0.5, 0.75]) == pytest.approx(_expect(vals, [0.25, 0.5, 0.75]))
    assert len(passes) <= 2


def test_infinities_zeros_and_extremes(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW_ROWS", 1)
    vals = [float("-inf"), -1.7e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 1.0, 1.0000000000000002, 1.7e308, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for i, want in enumerate(sorted(vals)):
        assert S.global_quantiles(df, "v", [i / (len(vals) - 1)])[0] == want


def test_empty_and_single(spark):
    empty = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert S.global_quantiles(empty, "v", [0.5]) == [None]
    assert S.quantile_frame(empty, "v", [0.5]).collect()[0]["value"] is None
    one = spark.createDataFrame([(3.5,)], "v double")
    assert S.global_quantiles(one, "v", [0.0, 0.5, 1.0]) == [3.5, 3.5, 3.5]
    with pytest.raises(ValueError):
        S.global_quantiles(one, "v", [1.5])


def test_no_sketch_in_exact_plans(data):
    _, df = data
    text = exact_quantiles(df, "v", [0.5])._jdf.queryExecution().toString()
    assert "percentile_approx" not in text and "rangepartitioning" not in text


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=80),
       st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]), min_size=1, max_size=3, unique=True))
def test_property(spark, values, probs):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert S.global_quantiles(df, "v", probs) == pytest.approx(_expect(np.array(values), probs), rel=1e-12, abs=1e-6)


@pytest.mark.parametrize("few", [S.FEW_ROWS, 2])
def test_groups(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW_ROWS", few)
    rng = np.random.default_rng(8)
    n = 20000
    pdf = pd.DataFrame({"g": rng.choice(["hot", "b", "c", None], size=n, p=[0.6, 0.2, 0.15, 0.05]), "v": rng.normal(100, 30, n).round(2)})
    pdf.loc[rng.random(n) < 0.35, "v"] = 42.0
    pdf.loc[rng.random(n) < 0.01, "v"] = np.nan
    got = {r["g"]: r for r in S.grouped_quantiles(spark.createDataFrame(pdf).repartition(8), "g", "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    for key, rows in pdf.groupby("g", dropna=False):
        row = got[None if pd.isna(key) else key]
        assert [row[f"q{i}"] for i in range(4)] == pytest.approx(_expect(rows["v"].dropna().to_numpy(), [0.0, 0.25, 0.5, 1.0]), rel=1e-12)


def test_many_groups_take_the_same_path(spark):
    from realpay.operators import box_stats
    rng = np.random.default_rng(9)
    n = 20000
    pdf = pd.DataFrame({"g": rng.integers(0, 5000, n), "v": rng.exponential(3, n)})
    got = {r["g"]: r for r in box_stats(spark.createDataFrame(pdf), "g", "v").collect()}
    assert len(got) == pdf["g"].nunique()
    for key, rows in list(pdf.groupby("g"))[:200]:
        q1, q3 = rows["v"].quantile(0.25), rows["v"].quantile(0.75)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert got[key]["q25"] == pytest.approx(q1, rel=1e-12)
        assert got[key]["n_outliers"] == int(((rows["v"] < lo) | (rows["v"] > hi)).sum())


def test_frames_agree(data):
    _, df = data
    probs = [0.25, 0.5, 0.75]
    frame = {r["prob"]: r["value"] for r in S.quantile_frame(df, "v", probs).collect()}
    assert frame == {r["prob"]: r["value"] for r in exact_quantiles(df, "v", probs).collect()}
    assert {r["prob"] for r in S.quantile_frame(df, "v", probs, method="approx").collect()} == set(probs)
    assert approx_quantiles(df, "v", probs).count() == 3


@pytest.mark.parametrize("key, most", [("ppp_describe", 16), ("salary_describe", 6)])
def test_few_jobs(spark, key, most):
    from realpay.plans.catalog import QUERIES
    group = f"jobs-{key}"
    spark.sparkContext.setJobGroup(group, key)
    try:
        QUERIES[key](spark, "/root/testdata/sf0.001").collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= most
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
