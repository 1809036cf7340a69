"""Report inputs derived from the given TPC-H-like tables.

The analysed report reads a job-postings fact table and a per-country
cost-of-living dimension; neither ships with it. These builders derive both
from the given tables so that every query's work grows with the data:

* ``jobs``        one posting per order (orders x customer x nation)
* ``cost_living`` one row per nation (the join dimension, 25 rows by spec)
* ``city_costs``  one row per customer: a cost table that grows with the data,
                  used by the dimension-profile reports
* ``skills``      one comma-separated skill list per part
* ``name_lists``  one comma-separated list per order, of many different names

The deterministic NULL / padding / junk injections (by key residue) exist
because the given tables contain no NULLs, no padded names and no outliers,
which would leave most branches of the report untested. They are fixed
values of the fixture definition, mirrored by the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from realpay.constants import COST_INDEX, LPP_INDEX, PLUS_RENT_INDEX
from realpay.functions.numbers import nan_to_null
from realpay.sources.tables import load_table, nan_as_null



def _null(dtype: str):
    return F.lit(None).cast(dtype)




_FROM_CUSTOMER = {"benefits_score", "company_location"}
_FROM_NATION = {"company_location"}
JOB_COLUMNS = ("job_id", "salary_usd", "experience_level", "years_experience", "benefits_score", "remote_ratio", "posting_date", "company_location")


def jobs(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    """Job postings: ``job_id, salary_usd, experience_level, years_experience,
    benefits_score, remote_ratio, posting_date, company_location``, or only ``columns``.

    Left joins on unique keys, so every order is one posting and a table that no
    wanted column needs is not joined at all. orders -> customer is a large
    equi-join (sort-merge, AQE splits a hot customer); customer -> nation has a
    25-row side that Spark broadcasts on its own size estimate. Salaries and
    scores hold NaN as well as NULL; both are missing, and NULL from here on.
    """
    columns = list(columns or JOB_COLUMNS)
    j = load_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    if _FROM_CUSTOMER & set(columns):
        c = load_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
        j = j.join(c, j["o_custkey"] == c["c_custkey"], "left")
    if _FROM_NATION & set(columns):
        n = load_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        j = j.join(n, j["c_nationkey"] == n["n_nationkey"], "left")
    k = F.col("o_orderkey")
    nbsp = F.lit("\u00a0")
    made = {
        "job_id": lambda: k,
        "salary_usd": lambda: F.when(k % 97 == 0, _null("double")).when(k % 101 == 0, F.lit(float("nan")))
                               .when(k % 50 == 0, F.col("o_totalprice") * 6).otherwise(F.col("o_totalprice")),
        "experience_level": lambda: F.when(k % 31 == 0, _null("string")).otherwise(F.col("o_orderpriority")),
        "years_experience": lambda: k % 21,
        "benefits_score": lambda: F.when(k % 13 == 0, _null("double")).when(k % 43 == 0, F.lit(float("nan")))
                                   .otherwise(F.col("c_acctbal") / 1000),
        "remote_ratio": lambda: F.when(k % 29 == 0, F.lit(None).cast("bigint")).otherwise((k % 3) * 50),
        "posting_date": lambda: F.when(k % 41 == 0, F.lit(None).cast("date")).otherwise(F.to_date(F.col("o_orderdate"))),
        "company_location": lambda: F.when(k % 37 == 0, _null("string")).when(k % 7 == 0, F.concat(nbsp, F.col("n_name"), nbsp))
                                     .when(k % 2 == 0, F.concat(F.lit(" "), F.col("n_name"), F.lit(" "))).otherwise(F.col("n_name")),
    }
    return nan_as_null(j.select(*[made[c]().alias(c) for c in columns]))


def cost_living(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-country cost indices, as strings on purpose (coercion is part of
    the report): ``Rank, Country`` and the three indices the report joins.

    Odd keys get a trailing blank (the join trims it away); nation 24 is
    spelled with a suffix, so its postings find no match (unmatched rows).
    """
    n = load_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey")
    return n.select(
        (k + 1).alias("Rank"),
        F.when(k == 24, F.concat(F.col("n_name"), F.lit(" (disputed)")))
         .when(k % 2 == 1, F.concat(F.col("n_name"), F.lit(" ")))
         .otherwise(F.col("n_name")).alias("Country"),
        F.when((k % 11).isin(3, 5), F.lit("n/a"))
         .otherwise((F.lit(20) + F.lit(9) * k).cast("string")).alias(COST_INDEX),
        F.when((k % 11).isin(3, 4), _null("string"))
         .otherwise((F.lit(12) + F.lit(4) * k).cast("string")).alias(PLUS_RENT_INDEX),
        F.when(k % 13 == 6, F.lit(""))
         .otherwise((F.lit(10) + F.lit(5) * k).cast("string")).alias(LPP_INDEX),
    )


def city_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cost-of-living table at customer ("city") grain: grows with the data.

    Mixed types for the profilers: ``Rank`` (bigint), ``Country`` (string,
    sometimes padded), two index columns kept as strings with ``'n/a'``,
    empty and NULL entries, and two double indices (one with NULLs).
    """
    c = load_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = load_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        k.alias("Rank"),
        F.when(k % 2 == 1, F.concat(F.col("n_name"), F.lit(" ")))
         .otherwise(F.col("n_name")).alias("Country"),
        F.when((k % 11).isin(3, 5), F.lit("n/a"))
         .otherwise((F.lit(20) + k % 83).cast("string")).alias(COST_INDEX),
        F.when((k % 11).isin(3, 4), _null("string"))
         .when(k % 13 == 6, F.lit(""))
         .otherwise((F.lit(12) + k % 61).cast("string")).alias(PLUS_RENT_INDEX),
        nan_to_null(F.col("c_acctbal") / 100).alias("Groceries Index"),
        F.when(k % 17 == 0, _null("double")).otherwise(F.col("c_acctbal") / 50 + 30).alias(LPP_INDEX),
    )


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``required_skills`` lists from part names (``'a , b , c'``), with NULL
    and blank-only lists mixed in."""
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey")
    return p.select(
        k.alias("job_id"),
        F.when(k % 17 == 0, _null("string"))
         .when(k % 19 == 0, F.lit(" , "))
         .when(k % 5 == 0, F.replace(F.col("p_name"), F.lit(" "), F.lit("\u00a0,\u00a0")))
         .otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit(" , "))).alias("required_skills"),
    )


def name_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``names`` lists from orders: the customer's own name, on every third order a priority, on every fifth the clerk's
    shift. The names grow with the data; the few others are frequent."""
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("job_id"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"),
                 F.when(k % 3 == 0, F.concat(F.lit(" , "), F.col("o_orderpriority"))).otherwise(""),
                 F.when(k % 5 == 0, F.concat(F.lit(",Shift "), (F.col("o_custkey") % 7).cast("string"))).otherwise("")).alias("names"),
    )
