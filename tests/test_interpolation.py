"""Interpolation equals DuckDB's quantile_cont to the last bit."""

import math
import random

import duckdb
import numpy as np
import pytest

from realpay.functions.interpolation import fma, lerp_value
from realpay.operators.quantiles import exact_quantiles
from realpay.operators.selection import global_quantiles


def test_emulated_fma_equals_true_fma(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(20000):
        a = round(rng.uniform(-1e6, 1e6), rng.randint(0, 4))
        d = rng.random()
        b = round(rng.uniform(-1e6, 1e6), rng.randint(0, 4))
        rows.append((a, 1.0 - d, b * d))
    df = spark.createDataFrame(rows, "a double, b double, c double")
    from pyspark.sql import functions as F
    got = [r["r"] for r in df.select(fma(F.col("a"), F.col("b"), F.col("c")).alias("r")).collect()]
    assert got == [math.fma(a, b, c) for a, b, c in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_bitwise_equal_duckdb(spark, seed):
    rng = np.random.default_rng(seed)
    con = duckdb.connect()
    probs = [0.1, 0.25, 0.3, 0.5, 0.75, 0.9]
    for n in (2, 7, 33, 101):
        vals = rng.uniform(-1e6, 1e6, n).round(int(rng.integers(0, 4)))
        df = spark.createDataFrame([(float(v),) for v in vals], "v double")
        duck = [con.execute(f"SELECT quantile_cont(x, {p}) FROM (SELECT unnest(?::DOUBLE[]) x)",
                            [vals.tolist()]).fetchone()[0] for p in probs]
        long = {r["prob"]: r["value"] for r in exact_quantiles(df, "v", probs).collect()}
        assert [long[p] for p in probs] == duck
        assert global_quantiles(df, "v", probs) == duck


def test_lerp_value_rule():
    assert lerp_value(-176423.2, 564882.3, 0.25) == math.fma(-176423.2, 0.75, 564882.3 * 0.25)
