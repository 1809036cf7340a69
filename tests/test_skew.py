"""A third of all rows on one key: results stay whole and exact, and the
shuffle-join path lets AQE split the hot partition."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from realpay.operators import box_stats, group_means, join_dimension
from realpay.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(5)
    n = 30000
    loc = rng.choice([f"C{i}" for i in range(30)], size=n).astype(object)
    loc[: n // 3] = " HOT "                       # a third of all rows on one key
    sal = rng.lognormal(11, 0.5, n)
    pdf = pd.DataFrame({"id": np.arange(n), "loc": loc, "sal": sal}).sample(frac=1.0, random_state=1)
    return pdf, spark.createDataFrame(pdf).repartition(16)


def test_shuffle_join_with_hot_key_is_whole_and_split(spark, hot):
    pdf, facts = hot
    dim = spark.createDataFrame([(f"C{i}", float(i)) for i in range(30)] + [("HOT", 99.0)], "country string, x double")
    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        out = join_dimension(facts, dim, "loc", "country", {"x": "x"})
        rows = out.collect()   # runs this DataFrame's own plan, so its final AQE plan is inspectable
        assert len(rows) == len(pdf)
        assert sum(1 for r in rows if r["x"] == 99.0) == len(pdf) // 3
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_group_quantiles_and_box_stats_exact(hot):
    pdf, df = hot
    q = exact_quantiles(df, "sal", [0.25, 0.5, 0.75], by=["loc"]).toPandas()
    hot_vals = pdf.loc[pdf["loc"] == " HOT ", "sal"]
    for p in (0.25, 0.5, 0.75):
        got = q[(q["loc"] == " HOT ") & (q["prob"] == p)]["value"].iloc[0]
        assert got == pytest.approx(hot_vals.quantile(p), rel=1e-12)
    b = box_stats(df, "loc", "sal").where(F.col("loc") == " HOT ").first()
    q1, q3 = hot_vals.quantile(0.25), hot_vals.quantile(0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert b["n_outliers"] == int(((hot_vals < lo) | (hot_vals > hi)).sum())
    assert b["hi_whisker"] == hot_vals[hot_vals <= hi].max()


def test_hot_group_means_pre_aggregate(hot):
    pdf, df = hot
    got = group_means(df, "loc", {"avg": "sal"}, scale=None).where(F.col("loc") == " HOT ").first()
    assert got["job_count"] == len(pdf) // 3
    plan = group_means(df, "loc", {"avg": "sal"})._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan or "partial_" in plan
