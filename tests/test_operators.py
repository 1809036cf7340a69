"""Operator semantics on literal frames (NULL groups, counts, corr, growth,
describe, box stats, dimension join)."""

import pytest

from realpay.operators import (box_stats, category_counts, corr_matrix, describe_all, describe_numeric,
                               group_means, iqr_filter, iqr_outliers, join_dimension, missing_profile,
                               monthly_trend, top_tokens)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 100.0, "SE", 0, "2024-01-05"), (2, 200.0, "SE", 50, "2024-01-20"), (None, 300.0, "EN", 100, "2024-02-01"),
            (4, None, None, None, "2024-03-03"), (5, 500.0, "EX", 0, None), (6, 1000.0, "SE", 100, "2024-03-09")]
    return spark.createDataFrame(rows, "job_id int, salary double, level string, remote int, posting string")


def test_missing_profile(small):
    got = {r["column"]: (r["missing"], r["percentage"]) for r in missing_profile(small).collect()}
    assert got["job_id"] == (1, round(1 / 6 * 100, 2))
    assert got["salary"] == (1, 16.67) and got["posting"] == (1, 16.67)
    no_pct = missing_profile(small, with_pct=False)
    assert no_pct.columns == ["column", "missing"]


def test_category_counts_drops_null_sql_group_keeps_it(small):
    # N10: value_counts drops the NULL key, GROUP BY keeps it
    counts = category_counts(small, "level").collect()
    assert [(r["level"], r["count"]) for r in counts] == [("SE", 3), ("EN", 1), ("EX", 1)]
    grouped = group_means(small, "level", {"avg_salary": "salary"}, order_by="level").collect()
    assert [r["level"] for r in grouped] == ["EN", "EX", "SE", None]   # N8: NULL last


def test_group_means_rounds_and_limits(spark):
    df = spark.createDataFrame([("a", 1.005), ("a", 1.005), ("b", 0.125), ("c", 0.5)], "k string, v double")
    got = group_means(df, "k", {"avg": "v"}, order_by="avg", descending=True, k=2).collect()
    assert [(r["k"], r["avg"], r["job_count"]) for r in got] == [("a", 1.0, 2), ("c", 0.5, 1)]


def test_describe_numeric(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 10]] + [(None,)], "v double")
    got = {r["stat"]: r["value"] for r in describe_numeric(df, "v").collect()}
    # N3: exact linear quartiles (df.summary() would give 1.0 for 25%)
    assert got == {"count": 3.0, "mean": 4.33, "std": 4.93, "min": 1.0, "25%": 1.5, "50%": 2.0, "75%": 6.0,
                   "max": 10.0}
    one = {r["stat"]: r["value"] for r in describe_numeric(df.limit(1).where("v is not null"), "v").collect()}
    assert one.get("std") is None   # N19: std of one value is NULL


def test_describe_all_mixed(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (2, "y", None), (3, "x", 4.0), (4, None, 8.0)],
                               "r int, s string, d double")
    got = {r["column"]: r.asDict() for r in describe_all(df).collect()}
    assert got["s"]["count"] == 3 and got["s"]["unique"] == 2 and got["s"]["top"] == "x" and got["s"]["freq"] == 2
    assert got["s"]["mean"] is None
    assert got["r"]["count"] == 4 and got["r"]["q50"] == 2.5 and got["r"]["unique"] is None
    assert got["d"]["count"] == 3 and got["d"]["min"] == 2.0 and got["d"]["max"] == 8.0 and got["d"]["q25"] == 3.0


def test_describe_all_top_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "s string")
    assert describe_all(df).first()["top"] == "a"


def test_corr_matrix_constant_column_is_null_not_error(spark):
    # N5: F.corr would divide by zero under ANSI
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 6.2, 5.0), (None, 1.0, 5.0)],
                               "a double, b double, c double")
    got = {(r["col_x"], r["col_y"]): r["corr"] for r in corr_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "a")] == 1.0 and got[("a", "b")] == got[("b", "a")] == 1.0
    assert got[("a", "c")] is None and got[("c", "c")] is None
    assert len(got) == 9


def test_monthly_trend_ffill_and_zero_division(spark):
    rows = [("2024-01-10", 1, 100.0), ("2024-02-10", 2, None), ("2024-03-10", 3, 150.0), ("2024-04-10", 4, 0.0),
            ("2024-05-10", 5, 30.0), (None, 6, 999.0)]
    df = spark.createDataFrame(rows, "d string, id int, s double")
    out = monthly_trend(df, "d", "id", {"avg_s": "s"}, growth={"g": "avg_s"}).orderBy("month").collect()
    assert [r["month"] for r in out] == ["2024-01", "2024-02", "2024-03", "2024-04", "2024-05"]
    g = [r["g"] for r in out]
    assert g[0] is None and g[1] == 0.0 and g[2] == pytest.approx(50.0) and g[3] == -100.0
    assert g[4] is None   # N6: x/0 -> NULL (pandas would give inf)


def test_monthly_count_skips_null_ids(spark):
    # N14: count(job_id) skips missing ids, unlike COUNT(*)
    df = spark.createDataFrame([("2024-01-01", None), ("2024-01-02", 2)], "d string, id int")
    assert monthly_trend(df, "d", "id", {}).first()["job_count"] == 1


def test_top_tokens(spark):
    df = spark.createDataFrame([("python , sql",), (" , ",), (None,), ("sql,go",), ("",)], "s string")
    got = [(r["skill"], r["count"]) for r in top_tokens(df, "s", ",", k=10).collect()]
    assert got == [("sql", 2), ("go", 1), ("python", 1)]


def test_iqr_outliers_strict_and_filter_inclusive(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, -5.5, 14.5, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    # q1=2.5, q3=7.5, iqr=5 -> fences -5 and 15 over the 11 values? compute with numpy
    import numpy as np
    q1, q3 = np.quantile(vals, 0.25), np.quantile(vals, 0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    out = sorted(r["v"] for r in iqr_outliers(df, "v").collect())
    inn = sorted(r["v"] for r in iqr_filter(df, "v").collect())
    assert out == sorted(v for v in vals if v < lo or v > hi)
    assert inn == sorted(v for v in vals if lo <= v <= hi)
    # fences on the boundary: inclusive filter keeps, strict outlier test skips
    edge = spark.createDataFrame([(0.0,), (0.0,), (10.0,), (10.0,), (-15.0,), (25.0,)], "v double")
    assert sorted(r["v"] for r in iqr_filter(edge, "v").collect()) == [-15.0, 0.0, 0.0, 10.0, 10.0, 25.0]
    assert iqr_outliers(edge, "v").count() == 0
    empty = spark.createDataFrame([(None,), (None,)], "v double")
    assert iqr_filter(empty, "v").count() == 0 and iqr_outliers(empty, "v").count() == 0


def test_box_stats(spark):
    rows = [("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", 5.0), ("b", 7.0), (None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r.asDict() for r in box_stats(df, "g", "v").collect()}
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert (a["q25"], a["q50"], a["q75"]) == (2.0, 3.0, 4.0)
    assert (a["lo_whisker"], a["hi_whisker"], a["n_outliers"]) == (1.0, 4.0, 1)
    assert got["b"]["n_outliers"] == 0 and got["b"]["q50"] == 6.0


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_join_dimension_broadcast_and_shuffle(spark, threshold):
    facts = spark.createDataFrame([(1, " A "), (2, "B"), (3, None), (4, "Z"), (5, "\u00a0A")], "id int, loc string")
    dim = spark.createDataFrame([("A ", 1.0), (" B", 2.0), ("B", 3.0), (None, 9.0)], "country string, x double")
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        got = join_dimension(facts, dim, "loc", "country", {"x": "x"})
        rows = sorted((r["id"], r["x"]) for r in got.collect())
    finally:
        spark.conf.set(key, old)
    # fan-out on the duplicated trimmed key "B"; unmatched and NULL keys kept
    assert rows == [(1, 1.0), (2, 2.0), (2, 3.0), (3, None), (4, None), (5, 1.0)]
    assert got.columns == ["id", "loc", "x"]


def test_describe_approx_method(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 1001)], "v double")
    got = {r["stat"]: r["value"] for r in describe_numeric(df, "v", method="approx").collect()}
    assert set(got) == {"count", "mean", "std", "min", "25%", "50%", "75%", "max"}
    assert abs(got["50%"] - 500.5) <= 1.0 and got["count"] == 1000.0


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "g string, v double, s string")
    assert describe_all(empty).count() == 3
    assert {r["stat"]: r["value"] for r in describe_numeric(empty, "v").collect()}["count"] == 0.0
    assert box_stats(empty, "g", "v").count() == 0
    assert iqr_filter(empty, "v").count() == 0 and iqr_outliers(empty, "v").count() == 0
    assert missing_profile(empty).where("missing = 0").count() == 3
    assert corr_matrix(empty, ["v"]).first()["corr"] is None
    assert top_tokens(empty, "s").count() == 0


def test_nan_is_missing_everywhere(spark):
    nan = float("nan")
    df = spark.createDataFrame([(i, float(i), "a", "2024-01-01") for i in range(20)] + [(20, nan, "a", "2024-01-02")], "id int, v double, g string, d string")
    assert iqr_outliers(df, "v").count() == 0 and iqr_filter(df, "v").count() == 20
    row = {r["column"]: r for r in describe_all(df).collect()}["v"]
    assert (row["count"], row["mean"], row["max"], row["q50"]) == (20, 9.5, 19.0, 9.5)
    assert group_means(df, "g", {"m": "v"}).first()["m"] == 9.5
    assert monthly_trend(df, "d", "id", {"m": "v"}).first()["m"] == 9.5
    from realpay.plans.ppp import ppp_population
    assert ppp_population(df.withColumnRenamed("v", "ppp_salary")).count() == 20


def test_top_tokens_trims_unicode_spaces(spark):
    df = spark.createDataFrame([("\u00a0SQL\u00a0,SQL",)], "s string")
    assert [(r["skill"], r["count"]) for r in top_tokens(df, "s").collect()] == [("SQL", 2)]
