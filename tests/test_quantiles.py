"""Distributed exact quantiles against numpy, including skewed inputs."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from realpay.operators.quantiles import approx_quantiles, exact_quantiles, quantile_row

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _check(res: pd.DataFrame, pdf: pd.DataFrame, by, probs):
    groups = pdf.groupby(by, dropna=False) if by else [((None,), pdf)]
    n_groups = 0
    for key, sub in groups:
        vals = sub["v"].dropna().to_numpy(dtype=float)
        if len(vals) == 0:
            continue
        n_groups += 1
        sel = res
        if by:
            k = key[0] if isinstance(key, tuple) else key
            sel = res[res["g"].isna()] if pd.isna(k) else res[res["g"] == k]
        for p in probs:
            got = sel.loc[sel["prob"] == p, "value"].to_numpy()
            assert len(got) == 1, (key, p)
            assert got[0] == pytest.approx(np.quantile(vals, p), rel=1e-12, abs=1e-9), (key, p)
    assert len(res) == n_groups * len(probs)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 60000
    g = rng.choice(["hot", "b", "c", None], size=n, p=[0.6, 0.2, 0.15, 0.05])
    v = rng.normal(100, 30, n).round(2)
    v[rng.random(n) < 0.35] = 42.0            # a third of all rows share one value
    v[rng.random(n) < 0.01] = np.nan
    pdf = pd.DataFrame({"g": g, "v": v})
    return pdf, spark.createDataFrame(pdf).repartition(12)


def test_global_exact_matches_numpy(skewed):
    pdf, df = skewed
    _check(exact_quantiles(df, "v", PROBS).toPandas(), pdf, [], PROBS)


def test_grouped_exact_matches_numpy(skewed):
    pdf, df = skewed
    _check(exact_quantiles(df, "v", PROBS, by=["g"]).toPandas(), pdf, ["g"], PROBS)


def test_many_small_groups(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.integers(0, 300, 5000).astype(str), "v": rng.exponential(5, 5000)})
    res = exact_quantiles(spark.createDataFrame(pdf), "v", [0.25, 0.5, 0.75], by=["g"]).toPandas()
    _check(res, pdf, ["g"], [0.25, 0.5, 0.75])


def test_edge_sizes(spark):
    pdf = pd.DataFrame({"g": ["one", "two", "two", "none"], "v": [5.0, 1.0, 3.0, np.nan]})
    res = exact_quantiles(spark.createDataFrame(pdf), "v", [0.0, 0.5, 1.0], by=["g"]).toPandas()
    _check(res, pdf, ["g"], [0.0, 0.5, 1.0])
    assert "none" not in set(res["g"])  # no values, no rows


def test_quantile_row_and_partitioning_invariance(spark, skewed):
    pdf, df = skewed
    a = quantile_row(df, "v", [0.25, 0.75], names=["q1", "q3"]).first()
    b = quantile_row(df.repartition(3), "v", [0.25, 0.75], names=["q1", "q3"]).first()
    assert a == b
    vals = pdf["v"].dropna()
    assert a["q1"] == pytest.approx(vals.quantile(0.25)) and a["q3"] == pytest.approx(vals.quantile(0.75))


def test_approx_within_rank_error(spark, skewed):
    pdf, df = skewed
    res = approx_quantiles(df, "v", [0.1, 0.5, 0.9], accuracy=1000).toPandas()
    vals = np.sort(pdf["v"].dropna().to_numpy())
    for _, r in res.iterrows():
        rank = np.searchsorted(vals, r["value"], side="right") / len(vals)
        lo_rank = np.searchsorted(vals, r["value"], side="left") / len(vals)
        assert lo_rank - 2e-3 <= r["prob"] <= rank + 2e-3


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=60),
       st.sampled_from([0.0, 0.25, 0.5, 0.75, 1.0]))
def test_property_single_prob(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = exact_quantiles(df, "v", [p]).first()["value"]
    assert got == pytest.approx(np.quantile(np.array(values), p), rel=1e-12, abs=1e-6)
