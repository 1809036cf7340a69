"""The PPP flow against an independent pandas calculation at sf0.01, plus the
branch counts that show each rule is exercised."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from realpay.plans import catalog
from realpay.plans.ppp import merge_costs, ppp_frame, ppp_inliers, ppp_population, rank_by_ppp, with_ppp
from realpay.sources import fixtures
from tests.conftest import SF01


def _pd_tables():
    read = lambda t: pd.read_parquet(f"{SF01}/{t}.parquet")
    return read("orders"), read("customer"), read("nation")


def _pd_jobs(o, c, n):
    j = o.merge(c, left_on="o_custkey", right_on="c_custkey").merge(n, left_on="c_nationkey", right_on="n_nationkey")
    k = j["o_orderkey"]
    sal = np.where(k % 50 == 0, j["o_totalprice"] * 6, j["o_totalprice"]).astype(float)
    sal[((k % 97 == 0) | (k % 101 == 0)).to_numpy()] = np.nan
    loc = np.where(k % 7 == 0, "\u00a0" + j["n_name"] + "\u00a0", np.where(k % 2 == 0, " " + j["n_name"] + " ", j["n_name"])).astype(object)
    loc[(k % 37 == 0).to_numpy()] = None
    return pd.DataFrame({"job_id": k, "salary_usd": sal, "company_location": loc})


def _pd_costs(n):
    k = n["n_nationkey"]
    country = np.where(k % 2 == 1, n["n_name"] + " ", n["n_name"]).astype(object)
    country[(k == 24).to_numpy()] = (n["n_name"] + " (disputed)")[k == 24]
    idx = np.where(k % 11 == 3, "n/a", np.where(k % 11 == 5, "n/a", (20 + 9 * k).astype(str))).astype(object)
    plus = (12 + 4 * k).astype(str).astype(object)
    plus[((k % 11 == 3) | (k % 11 == 4)).to_numpy()] = None
    lpp = np.where(k % 13 == 6, "", (10 + 5 * k).astype(str)).astype(object)
    return pd.DataFrame({"Country": country, "col_index": idx, "col_plus_rent": plus, "lpp": lpp})


def _pd_flow():
    o, c, n = _pd_tables()
    jobs, costs = _pd_jobs(o, c, n), _pd_costs(n)
    jobs["_k"] = jobs["company_location"].str.strip()
    costs["_k"] = costs["Country"].str.strip()
    m = jobs.merge(costs.drop(columns="Country"), on="_k", how="left")
    for col in ("col_index", "col_plus_rent", "lpp"):
        m[col] = pd.to_numeric(m[col], errors="coerce")

    def weighted(row):
        a, b = row["col_index"], row["col_plus_rent"]
        if pd.notnull(a) and pd.notnull(b):
            val = 0.5 * a + 0.5 * b
        elif pd.isnull(a) and pd.isnull(b):
            return None
        else:
            val = a if pd.notnull(a) else b
        return max(40, min(val, 150))

    m["weighted_col"] = m.apply(weighted, axis=1)
    m["clamped_lpp"] = m["lpp"].apply(lambda x: None if pd.isnull(x) else max(30, min(x, 80)))

    def ppp(row):
        if pd.isnull(row["weighted_col"]) or pd.isnull(row["clamped_lpp"]) or row["salary_usd"] < 2000:
            return None
        return row["salary_usd"] * (row["clamped_lpp"] / 100.0) / (row["weighted_col"] / 100.0)

    m["ppp_salary"] = m.apply(ppp, axis=1)
    pop = m.dropna(subset=["ppp_salary"])
    q1, q3 = pop["ppp_salary"].quantile(0.25), pop["ppp_salary"].quantile(0.75)
    iqr = q3 - q1
    final = pop[(pop["ppp_salary"] >= q1 - 1.5 * iqr) & (pop["ppp_salary"] <= q3 + 1.5 * iqr)]
    return m, pop, final


@pytest.fixture(scope="module")
def pd_flow():
    return _pd_flow()


def test_branch_counts_match_pandas(spark, pd_flow):
    m, pop, final = pd_flow
    ppp = catalog.ppp_salaries(spark, SF01)
    assert ppp.count() == len(m) == 15000
    assert ppp_population(ppp).count() == len(pop) == 11253
    assert ppp_inliers(ppp).count() == len(final) == 11075


def test_ppp_values_match_pandas(spark, pd_flow):
    m, _, _ = pd_flow
    got = catalog.ppp_salaries(spark, SF01).select("job_id", "ppp_salary").toPandas().set_index("job_id")["ppp_salary"]
    exp = m.set_index("job_id")["ppp_salary"].astype(float)
    both = pd.concat([got.rename("g"), exp.rename("e")], axis=1)
    assert both["g"].isna().equals(both["e"].isna())
    assert np.allclose(both["g"].dropna(), both["e"].dropna(), rtol=0, atol=0)


def test_ranking_matches_pandas_on_raw_keys(spark, pd_flow):
    _, _, final = pd_flow
    agg = final.groupby("company_location").agg(avg_ppp=("ppp_salary", "mean"), n=("ppp_salary", "size"))
    agg = agg[agg["n"] >= 10].reset_index()
    agg["avg_ppp"] = agg["avg_ppp"].round(2)
    exp = agg.sort_values(["avg_ppp", "company_location"], ascending=[False, True]).head(10)
    got = catalog.q_ppp_country_ranking(spark, SF01).toPandas()
    assert list(got["company_location"]) == list(exp["company_location"])
    assert list(got["job_count"]) == list(exp["n"])
    assert np.allclose(got["avg_ppp_salary"], exp["avg_ppp"], atol=0.011)
    # the raw key keeps padded and unpadded spellings apart
    assert any(x.startswith(" ") for x in got["company_location"])


def test_dimension_side_factors_equal_row_side(spark):
    jobs = fixtures.jobs(spark, SF01)
    costs = fixtures.cost_living(spark, SF01)
    cols = ["job_id", "col_index", "col_plus_rent", "lpp", "weighted_col", "clamped_lpp", "ppp_salary"]
    a = with_ppp(merge_costs(jobs, costs)).select(*cols)
    b = ppp_frame(jobs, costs).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_clamp_branches_are_hit(spark):
    ppp = catalog.ppp_salaries(spark, SF01)
    row = ppp.agg(
        F.count_if(F.col("weighted_col") == 40.0).alias("w_lo"),
        F.count_if(F.col("weighted_col") == 150.0).alias("w_hi"),
        F.count_if(F.col("clamped_lpp") == 30.0).alias("l_lo"),
        F.count_if(F.col("clamped_lpp") == 80.0).alias("l_hi"),
        F.count_if(F.col("salary_usd") < 2000).alias("low_salary"),
    ).first()
    assert row["w_lo"] > 0 and row["w_hi"] > 0 and row["l_lo"] > 0 and row["l_hi"] > 0
    assert row["low_salary"] > 0


def test_ranking_drops_small_groups_after_outliers(spark):
    final = ppp_inliers(catalog.ppp_salaries(spark, SF01))
    top = rank_by_ppp(final, min_jobs=10, k=1000).toPandas()
    assert (top["job_count"] >= 10).all()


def test_ranking_on_trimmed_keys_matches_pandas(spark, pd_flow):
    _, _, final = pd_flow
    f = final.assign(company_location=final["company_location"].str.strip())
    agg = f.groupby("company_location").agg(avg_ppp=("ppp_salary", "mean"), n=("ppp_salary", "size"))
    agg = agg[agg["n"] >= 10].reset_index()
    agg["avg_ppp"] = agg["avg_ppp"].round(2)
    exp = agg.sort_values(["avg_ppp", "company_location"], ascending=[False, True]).head(10)
    got = rank_by_ppp(ppp_inliers(catalog.ppp_salaries(spark, SF01)), normalize=True).toPandas()
    assert list(got["company_location"]) == list(exp["company_location"])
    assert list(got["job_count"]) == list(exp["n"])
    assert not any(x.startswith(" ") for x in got["company_location"])


def test_ppp_from_a_csv_dimension(spark, tmp_path):
    """The cost table read from a CSV file (inferred types, NA tokens) gives
    the same PPP salaries as the frame it was written from."""
    from realpay.sources import read_table
    costs = fixtures.cost_living(spark, SF01)
    path = str(tmp_path / "costs.csv")
    costs.toPandas().to_csv(path, index=False)
    from_csv = read_table(spark, path)
    jobs = fixtures.jobs(spark, SF01)
    cols = ["job_id", "weighted_col", "clamped_lpp", "ppp_salary"]
    a = ppp_frame(jobs, costs).select(*cols)
    b = ppp_frame(jobs, from_csv).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
