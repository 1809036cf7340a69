"""Trap tests: each semantic difference between pandas, SQL and Spark that
the report depends on, on small literal frames."""

import math

import pytest
from pyspark.sql import functions as F

from realpay.functions import (clamp, normalize_key, ppp_salary, round_half_away, round_half_even,
                               split_tokens, strict_number, weighted_index)


def _vals(df, col="r"):
    return [r[col] for r in df.collect()]


def test_roundings_match_pandas_and_sql(spark):
    # N2: pandas half-even on the scaled value, SQL half away on the scaled value
    df = spark.createDataFrame([(1.005,), (0.125,), (2.345,), (-0.125,), (2.5,), (-2.5,)], "x double")
    even = _vals(df.select(round_half_even("x", 2).alias("r")))
    away = _vals(df.select(round_half_away("x", 2).alias("r")))
    assert even == [1.0, 0.12, 2.35, -0.12, 2.5, -2.5]
    assert away == [1.0, 0.13, 2.35, -0.13, 2.5, -2.5]
    # Spark's own round works on the decimal string and differs on 1.005
    assert df.select(F.round("x", 2).alias("r")).first()["r"] == 1.01


def test_roundings_match_numpy_on_many_values(spark):
    import numpy as np
    xs = np.random.default_rng(3).uniform(-1000, 1000, 2000).round(6)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = _vals(df.select(round_half_even("x", 2).alias("r")))
    assert got == [float(v) for v in np.round(xs, 2)]


def test_clamp_keeps_null(spark):
    # N1: greatest/least skip NULLs; the guarded clamp does not invent a bound
    df = spark.createDataFrame([(None,), (10.0,), (100.0,), (200.0,)], "x double")
    assert _vals(df.select(clamp("x", 40, 150).alias("r"))) == [None, 40.0, 100.0, 150.0]
    assert df.select(F.greatest(F.lit(40.0), F.least(F.col("x"), F.lit(150.0))).alias("r")).first()["r"] == 150.0


def test_strict_number_follows_pandas(spark):
    # N4: Spark try_cast accepts '1.0f' and '1d'; pandas to_numeric does not
    raw = ["29", " 2 ", "1e3", "-3.5", ".5", "inf", "n/a", "", None, "1.0f", "1d", "nan", "12abc"]
    df = spark.createDataFrame([(s,) for s in raw], "s string")
    got = _vals(df.select(strict_number("s").alias("r")))
    assert got[:6] == [29.0, 2.0, 1000.0, -3.5, 0.5, math.inf]
    assert got[6:] == [None] * 7
    assert df.where(F.col("s") == "1.0f").select(F.col("s").try_cast("double").alias("r")).first()["r"] == 1.0


def test_weighted_index_branches(spark):
    df = spark.createDataFrame([(60.0, 40.0), (None, 200.0), (10.0, None), (None, None), (100.0, 300.0)],
                               "a double, b double")
    got = _vals(df.select(weighted_index("a", "b").alias("r")))
    assert got == [50.0, 150.0, 40.0, None, 150.0]


def test_ppp_salary_rules(spark):
    df = spark.createDataFrame(
        [(100000.0, 80.0, 50.0), (1999.0, 80.0, 50.0), (None, 80.0, 50.0), (5000.0, None, 50.0),
         (5000.0, 30.0, None), (2000.0, 30.0, 150.0)],
        "s double, lpp double, w double")
    got = _vals(df.select(ppp_salary("s", "lpp", "w").alias("r")))
    assert got[0] == 100000.0 * (80.0 / 100.0) / (50.0 / 100.0)
    assert got[1:5] == [None, None, None, None]
    assert got[5] == 2000.0 * (30.0 / 100.0) / (150.0 / 100.0)


def test_normalize_key_unicode_spaces(spark):
    # N7: default trim strips ASCII blanks only; the wide form strips NBSP too
    df = spark.createDataFrame([(" Chile ",), ("  Peru　",)], "s string")
    assert _vals(df.select(normalize_key("s", unicode_spaces=False).alias("r"))) == [" Chile", "Peru　"]
    assert _vals(df.select(normalize_key("s", unicode_spaces=True).alias("r"))) == ["Chile", "Peru"]


def test_split_tokens_is_literal(spark):
    # the separator is a literal, not a regex
    df = spark.createDataFrame([("a|b|c",), (None,)], "s string")
    got = _vals(df.select(split_tokens("s", "|").alias("r")))
    assert got == [["a", "b", "c"], None]


@pytest.mark.parametrize("value,expected", [(0.0, 0.0), (-0.0, 0.0)])
def test_round_zero(spark, value, expected):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(round_half_even("x").alias("r")).first()["r"] == expected
