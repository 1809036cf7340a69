"""CSV NA tokens, optional-column guards, fixtures and the driver entry."""

import os
import tempfile

import pytest
from pyspark.sql import types as T

from realpay.plans.quality import quality_report
from realpay.sources import fixtures, read_table
from tests.conftest import SF001, SF01


def test_csv_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="realpay-csv-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write("name,value\n")
        for name, value in [("a", "NA"), ("b", "None"), ("c", "null"), ("d", "n/a"), ("e", "NaN"),
                            ("f", ""), ("g", " padded "), ("h", "2.5"), ("NA", "-"), ("j", "1e3")]:
            f.write(f"{name},{value}\n")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
    got = {r["name"]: r["value"] for r in read_table(spark, path, schema).collect()}
    assert [got[k] for k in "abcdef"] == [None] * 6
    assert got["g"] == " padded " and got["h"] == "2.5" and got[None] == "-"
    typed = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())])
    vals = {r["name"]: r["value"] for r in read_table(spark, path, typed, lenient=True).collect()}
    assert vals["h"] == 2.5 and vals["j"] == 1000.0 and vals["e"] is None and vals["g"] is None


def test_optional_columns_are_skipped(spark):
    jobs = fixtures.jobs(spark, SF001)
    full = quality_report(jobs)
    assert set(full) == {"missing", "salary_stats", "salary_outliers", "category_counts"}
    partial = quality_report(jobs.drop("experience_level", "salary_usd"))
    assert set(partial) == {"missing"}


def test_fixture_injections_are_not_vacuous(spark):
    jobs = fixtures.jobs(spark, SF01)
    assert jobs.count() == 15000
    nulls = {c: jobs.where(jobs[c].isNull()).count() for c in jobs.columns}
    assert all(nulls[c] > 0 for c in jobs.columns if c not in ("job_id", "years_experience"))
    assert jobs.where(jobs.company_location.startswith(" ")).count() > 0
    costs = fixtures.city_costs(spark, SF01)
    assert costs.count() == 1500


def test_entry_runs_with_stable_schema(spark):
    from __spark_entry__ import entry
    a = entry(spark)
    b = entry(spark)
    assert a.schema == b.schema
    assert a.columns == ["company_location", "avg_nominal_salary", "avg_ppp_salary", "job_count"]
    assert a.count() >= 0


def test_cluster_settings_scale_with_input():
    from realpay.session import cluster_settings
    big = cluster_settings(100 * 1024 ** 4, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 81920
    small = cluster_settings(10 * 1024 ** 2, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16


def test_csv_type_inference_like_read_csv(spark):
    d = tempfile.mkdtemp(prefix="realpay-csv-")
    path = os.path.join(d, "costs.csv")
    with open(path, "w") as f:
        f.write("Rank,Country,Cost Index,Empty,Mixed\n")
        f.write("1,Alpha,101.1,,x1\n2,Beta Land,NA,NA,2\n3, Gamma ,38.5,null,3.5\n")
    df = read_table(spark, path)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    assert types == {"Rank": "bigint", "Country": "string", "Cost Index": "double", "Empty": "double",
                     "Mixed": "string"}
    rows = df.orderBy("Rank").collect()
    assert [r["Cost Index"] for r in rows] == [101.1, None, 38.5]
    assert rows[2]["Country"] == " Gamma " and rows[0]["Empty"] is None


def test_run_report_writes_every_section(spark, tmp_path):
    from realpay.plans.catalog import QUERIES
    from realpay.plans.report import SECTIONS, run_report
    assert sorted(SECTIONS) == sorted(QUERIES)
    out = str(tmp_path / "report")
    results = run_report(spark, SF001, out, sections=["missing_profile", "top_skills", "ppp_country_ranking"])
    for name, df in results.items():
        back = spark.read.parquet(os.path.join(out, name))
        assert back.count() == df.count() and sorted(back.columns) == sorted(df.columns)


def test_materialize_keeps_rows(spark):
    from realpay.operators.materialize import materialize
    jobs = fixtures.jobs(spark, SF001)
    a = materialize(jobs, ["job_id", "salary_usd"])
    assert a.columns == ["job_id", "salary_usd"] and a.exceptAll(jobs.select(*a.columns)).count() == 0


def _csv(text):
    path = os.path.join(tempfile.mkdtemp(prefix="realpay-csv-"), "t.csv")
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_columns_are_found_by_name(spark):
    path = _csv("id,name,score\n1,x,5.5\n")
    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    assert tuple(read_table(spark, path, schema).first()) == (5.5, 1, "x")
    with pytest.raises(ValueError):
        read_table(spark, path, T.StructType([T.StructField("absent", T.StringType())]))


def test_csv_quotes_and_line_breaks(spark):
    path = _csv('id,name\n1,"x\ny"\n2,"a ""b"" c"\n')
    rows = [tuple(r) for r in read_table(spark, path, multi_line=True).orderBy("id").collect()]
    assert rows == [(1, "x\ny"), (2, 'a "b" c')]


def test_csv_bad_values_raise_unless_lenient(spark):
    path = _csv("a,b\n1,99999999999999999999\n2,3\n")
    assert [r["b"] for r in read_table(spark, path).orderBy("a").collect()] == [1e20, 3.0]
    typed = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    assert [r["b"] for r in read_table(spark, path, typed, lenient=True).orderBy("a").collect()] == [None, 3]
    with pytest.raises(Exception, match="not a bigint"):
        read_table(spark, path, typed).collect()
    dates = _csv("d\n2024-01-05\nsoon\n")
    with pytest.raises(Exception, match="not a date"):
        read_table(spark, dates, T.StructType([T.StructField("d", T.DateType())])).collect()


def test_only_needed_tables_are_read(spark):
    from realpay.plans import catalog
    for key in ("salary_describe", "quantiles", "iqr_outliers", "experience_counts", "monthly_trend", "remote_stats"):
        for frame in [fixtures.jobs(spark, SF001, ("job_id", "salary_usd"))] + ([catalog.QUERIES[key](spark, SF001)] if key in ("experience_counts", "monthly_trend", "remote_stats") else []):
            plan = frame._jdf.queryExecution().toString()
            assert "customer.parquet" not in plan and "nation.parquet" not in plan, key
    assert "nation.parquet" not in catalog.QUERIES["corr_matrix"](spark, SF001)._jdf.queryExecution().toString()


def test_register_tables_raises_on_a_missing_one(spark, tmp_path):
    from realpay.sources.tables import register_tables
    register_tables(spark, SF001, ["region"])
    assert spark.sql("SELECT count(*) FROM region").first()[0] == 5
    with pytest.raises(Exception):
        register_tables(spark, str(tmp_path), ["region"])


def test_quality_frame_skips_absent_columns(spark):
    from realpay.plans.quality import optional_columns, quality_frame
    jobs = fixtures.jobs(spark, SF001)
    assert {r["section"] for r in quality_frame(jobs).select("section").distinct().collect()} == {"missing", "salary_stats", "salary_outliers", "category_counts"}
    assert {r["section"] for r in quality_frame(jobs.drop("salary_usd")).select("section").distinct().collect()} == {"missing", "category_counts"}
    assert [tuple(r) for r in optional_columns(jobs, ["job_id", "nope"]).collect()] == [("job_id", True, jobs.count()), ("nope", False, None)]


def test_sql_over_leaves_the_catalog_as_it_is(spark):
    from realpay.sources.tables import sql_over

    spark.range(3).createOrReplaceTempView("costs")
    before = sorted(t.name for t in spark.catalog.listTables())
    one, two = (sql_over(spark, "SELECT count(*) AS n FROM {costs} WHERE id < 5", costs=spark.range(n)) for n in (9, 4))
    assert sorted(t.name for t in spark.catalog.listTables()) == before
    assert one.first()["n"] == 5 and two.first()["n"] == 4 and spark.table("costs").count() == 3
    with pytest.raises(ValueError, match="does not name"):
        sql_over(spark, "SELECT 1", costs=spark.range(1))


def test_store_deletes_what_it_stored(spark):
    from realpay.store import Store

    with pytest.raises(RuntimeError):
        with Store(spark) as store:
            kept = store.keep(spark.range(5).withColumnRenamed("id", "x"), "numbers")
            folder = store._paths[0].removeprefix("file:")
            assert kept.count() == 5 and os.path.isdir(folder)
            raise RuntimeError
    assert not os.path.exists(folder)
