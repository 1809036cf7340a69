"""One scan, one stored frame, one summary where several would do as well."""

import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from realpay.operators import describe_numeric, top_tokens
from realpay.operators.grouping import frequent_candidates
from realpay.operators.joins import hot_keys, join_dimension
from realpay.operators.profile import category_counts, describe_all, missing_profile
from realpay.operators.outliers import iqr_outliers
from realpay.operators.selection import column_summaries
from realpay.plans import report as report_module
from realpay.plans.catalog import QUERIES
from realpay.plans.quality import quality_report
from realpay.sources import fixtures
from realpay.store import Store
from tests.conftest import SF001


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def jobs_of(spark, act):
    group = f"jobs-{act}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        act()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# -- moments and quartiles


def test_summaries_are_those_of_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.lognormal(9, 2, 5000), "b": np.where(rng.random(5000) < 0.4, 7.5, -rng.exponential(1e-3, 5000)), "c": 1e9 + rng.integers(0, 9, 5000),
                        "one": [4.0] + [np.nan] * 4999, "none": [np.nan] * 5000})
    found = column_summaries(spark.createDataFrame(pdf).repartition(5), list(pdf), [0.25, 0.5])
    for name, s in zip(pdf, found):
        own = pdf[name].dropna()
        assert s.n == len(own)
        want = [own.mean(), own.std(), own.min(), own.max(), *own.quantile([0.25, 0.5])]
        got = [s.mean, s.std, s.least, s.most, *s.quantiles]
        for have, need in zip(got, want):
            assert have is None if pd.isna(need) else have == pytest.approx(need, rel=1e-7)


def test_infinite_values(spark):
    s = column_summaries(spark.createDataFrame([(float(x),) for x in (1, 2, 3, "inf")], "v double"), ["v"], [0.5])[0]
    assert (s.n, s.mean, s.most, s.quantiles) == (4, float("inf"), float("inf"), (2.5,))


def test_describe_takes_few_jobs(spark):
    df = spark.range(20_000).select((F.col("id") * 1.5).alias("v")).repartition(4)
    assert jobs_of(spark, lambda: describe_numeric(df, "v").collect()) <= 8


def test_box_stats_take_few_jobs(spark):
    assert jobs_of(spark, lambda: QUERIES["salary_box_stats"](spark, SF001).collect()) <= 11


def test_many_columns_cost_as_many_times_one(spark):
    df = spark.range(60_000).select(*[((F.col("id") * (2 * i + 3)) % 50_021 / 7).alias(f"c{i}") for i in range(40)]).repartition(4)
    df.count()

    def seconds(n):
        t = time.time()
        describe_all(df.select(*df.columns[:n])).collect()
        return time.time() - t

    seconds(4)
    assert seconds(40) <= 10 * min(seconds(4), seconds(4))


# -- quality report


def test_quality_report_is_its_parts(spark):
    jobs = fixtures.jobs(spark, SF001)
    found = quality_report(jobs)
    assert rows(found["missing"]) == rows(missing_profile(jobs))
    assert rows(found["salary_stats"]) == rows(describe_numeric(jobs, "salary_usd"))
    assert rows(found["salary_outliers"]) == rows(iqr_outliers(jobs, "salary_usd"))
    assert found["category_counts"].collect() == category_counts(jobs, "experience_level").collect()


def test_quality_report_of_an_empty_table(spark):
    found = quality_report(fixtures.jobs(spark, SF001).limit(0))
    assert {r["missing"] for r in found["missing"].collect()} == {0}
    assert {r["stat"]: r["value"] for r in found["salary_stats"].collect()}["count"] == 0.0
    assert found["salary_outliers"].count() == found["category_counts"].count() == 0


def test_quality_report_scans_once_for_all_sections(spark):
    """Missing counts and category counts read the stored groups, not the table."""
    found = quality_report(fixtures.jobs(spark, SF001))
    for section in ("missing", "salary_stats", "category_counts"):
        assert "orders.parquet" not in found[section]._jdf.queryExecution().toString()


# -- whole report


def test_report_makes_the_population_once_and_leaves_nothing(spark, tmp_path, monkeypatch):
    made = []
    real = report_module.ppp_salaries
    monkeypatch.setattr(report_module, "ppp_salaries", lambda *a: made.append(1) or real(*a))

    class Kept(Store):
        def path(self, name):
            folders.append(super().path(name).removeprefix("file:"))
            return folders[-1]

    folders = []
    monkeypatch.setattr(report_module, "Store", Kept)
    sections = ("ppp_salary", "iqr_filter", "ppp_describe", "ppp_country_ranking", "remote_stats")
    out = report_module.run_report(spark, SF001, str(tmp_path), sections)
    assert made == [1] and folders and not any(os.path.exists(f) for f in folders)
    for name in sections:
        assert rows(out[name]) == rows(QUERIES[name](spark, SF001))


# -- frequent tokens


@pytest.fixture(scope="module")
def lists(spark):
    i = F.col("id")
    hot = F.concat(F.lit("hot"), (i % 12).cast("string"))
    return spark.range(1_000_000).select(F.when(i % 10 < 3, F.concat(hot, F.lit(" , "), i.cast("string"))).otherwise(F.concat(F.lit("w"), i.cast("string"))).alias("l"))


def test_summary_gives_the_same_top(lists):
    """A million different tokens; ranks 7 to 11 are equal, so the tie at rank 10 is decided by name."""
    plain, found = (top_tokens(lists, "l", summary=s).collect() for s in (None, 4096))
    assert found == plain and plain[9]["count"] == plain[8]["count"]


def test_candidates_are_few_and_shuffles_small(lists):
    tokens = lists.select(F.explode(F.split("l", " , ")).alias("t"))
    found = {r["t"] for r in frequent_candidates(tokens, "t", 10, 4096).collect()}
    assert {f"hot{i}" for i in range(12)} <= found and len(found) < 1024


def test_nothing_stands_out(spark):
    flat = spark.range(50_000).select(F.concat(F.lit("w"), (F.col("id") % 25_000).cast("string")).alias("t"))
    assert frequent_candidates(flat, "t", 10, 64) is None
    assert top_tokens(flat, "t", summary=64).collect() == top_tokens(flat, "t").collect()
    assert top_tokens(flat.limit(0), "t", summary=64).count() == 0


# -- joins


def test_facts_may_have_maps(spark):
    facts = spark.createDataFrame([("a ", {"x": 1}), (None, {"y": 2}), ("q", None)], "k string, m map<string,int>")
    dim = spark.createDataFrame([("a", 1.5)], "country string, cost double")
    for split in (False, True):
        assert rows(join_dimension(facts, dim, "k", "country", {"c": "cost"}, split_hot=split).select("k", "c")) == [("a ", 1.5), ("q", None), (None, None)]


def test_hot_key_is_split_without_adaptive_execution(spark):
    facts = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 900).cast("string")).alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("hot", 2), *((str(i), i) for i in range(0, 900, 2))], "k string, v int").repartition(3)
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, split = (join_dimension(facts, dim, "k", "k", {"v": "v"}, split_hot=s) for s in (False, True))
        assert rows(split) == rows(plain) and split.columns == ["id", "k", "v"]
        largest = [df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] for df in (plain, split)]
        assert largest[1] < 0.75 * largest[0]
        hot = hot_keys(facts.select("k"), "k", "n").collect()
        assert [r["k"] for r in hot] == ["hot"] and hot[0]["n"] >= 2
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
