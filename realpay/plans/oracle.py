"""Independent DuckDB SQL for every query key (the correctness oracle).

Written directly against the given tables (registered as views), so the
fixture derivation appears once more here as CTEs. pandas rounding is
``round_even(x * 10^s, 0) / 10^s`` and SQL rounding ``round(x, s)``; literal
constants are cast to DOUBLE so no DECIMAL arithmetic creeps in.
"""

from __future__ import annotations

# Number syntax of the report, written out here once more so that the oracle stands by itself.
NUMBER_SYNTAX = r"^\s*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def r_even(expr: str, scale: int = 2) -> str:
    f = f"{10 ** scale}.0::DOUBLE"
    return f"(round_even(({expr}) * {f}, 0) / {f})"


JOBS = """jobs AS (
  SELECT o.o_orderkey AS job_id,
    CASE WHEN o.o_orderkey % 97 = 0 OR o.o_orderkey % 101 = 0 THEN NULL WHEN o.o_orderkey % 50 = 0 THEN o.o_totalprice * 6
         ELSE o.o_totalprice END AS salary_usd,
    CASE WHEN o.o_orderkey % 31 = 0 THEN NULL ELSE o.o_orderpriority END AS experience_level,
    o.o_orderkey % 21 AS years_experience,
    CASE WHEN o.o_orderkey % 13 = 0 OR o.o_orderkey % 43 = 0 THEN NULL ELSE c.c_acctbal / 1000 END AS benefits_score,
    CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE (o.o_orderkey % 3) * 50 END AS remote_ratio,
    CASE WHEN o.o_orderkey % 41 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS posting_date,
    CASE WHEN o.o_orderkey % 37 = 0 THEN NULL
         WHEN o.o_orderkey % 7 = 0 THEN concat(chr(160), n.n_name, chr(160))
         WHEN o.o_orderkey % 2 = 0 THEN concat(' ', n.n_name, ' ') ELSE n.n_name END AS company_location
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey)"""

COST_LIVING = """cost_living AS (
  SELECT n_nationkey + 1 AS "Rank",
    CASE WHEN n_nationkey = 24 THEN concat(n_name, ' (disputed)')
         WHEN n_nationkey % 2 = 1 THEN concat(n_name, ' ') ELSE n_name END AS "Country",
    CASE WHEN n_nationkey % 11 IN (3, 5) THEN 'n/a'
         ELSE CAST(20 + 9 * n_nationkey AS VARCHAR) END AS "Cost of Living Index",
    CASE WHEN n_nationkey % 11 IN (3, 4) THEN NULL
         ELSE CAST(12 + 4 * n_nationkey AS VARCHAR) END AS "Cost of Living Plus Rent Index",
    CASE WHEN n_nationkey % 13 = 6 THEN ''
         ELSE CAST(10 + 5 * n_nationkey AS VARCHAR) END AS "Local Purchasing Power Index"
  FROM nation)"""

CITY_COSTS = """city_costs AS (
  SELECT c.c_custkey AS "Rank",
    CASE WHEN c.c_custkey % 2 = 1 THEN concat(n.n_name, ' ') ELSE n.n_name END AS "Country",
    CASE WHEN c.c_custkey % 11 IN (3, 5) THEN 'n/a'
         ELSE CAST(20 + c.c_custkey % 83 AS VARCHAR) END AS "Cost of Living Index",
    CASE WHEN c.c_custkey % 11 IN (3, 4) THEN NULL WHEN c.c_custkey % 13 = 6 THEN ''
         ELSE CAST(12 + c.c_custkey % 61 AS VARCHAR) END AS "Cost of Living Plus Rent Index",
    c.c_acctbal / 100 AS "Groceries Index",
    CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE c.c_acctbal / 50 + 30 END
      AS "Local Purchasing Power Index"
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

SKILLS = """skills AS (
  SELECT p_partkey AS job_id,
    CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN ' , '
         WHEN p_partkey % 5 = 0 THEN replace(p_name, ' ', concat(chr(160), ',', chr(160)))
         ELSE replace(p_name, ' ', ' , ') END AS required_skills
  FROM part)"""

MERGED = """merged AS (
  SELECT j.*, strftime(j.posting_date, '%Y-%m') AS month,
    c."Cost of Living Index" AS col_index,
    c."Cost of Living Plus Rent Index" AS col_plus_rent,
    c."Local Purchasing Power Index" AS lpp
  FROM jobs j LEFT JOIN cost_living c ON trim(j.company_location) = trim(c."Country"))"""


def _num(col: str) -> str:
    pat = NUMBER_SYNTAX.replace("'", "''")
    return (f"CASE WHEN regexp_matches({col}, '{pat}') "
            f"THEN TRY_CAST(trim({col}) AS DOUBLE) END")


PPP = f"""coerced AS (
  SELECT * REPLACE ({_num('col_index')} AS col_index, {_num('col_plus_rent')} AS col_plus_rent,
                    {_num('lpp')} AS lpp)
  FROM merged),
clamped AS (
  SELECT *,
    CASE WHEN col_index IS NOT NULL AND col_plus_rent IS NOT NULL
           THEN greatest(40.0::DOUBLE, least(0.5::DOUBLE * col_index + 0.5::DOUBLE * col_plus_rent, 150.0::DOUBLE))
         WHEN col_index IS NULL AND col_plus_rent IS NULL THEN NULL
         ELSE greatest(40.0::DOUBLE, least(coalesce(col_index, col_plus_rent), 150.0::DOUBLE)) END AS weighted_col,
    CASE WHEN lpp IS NULL THEN NULL ELSE greatest(30.0::DOUBLE, least(lpp, 80.0::DOUBLE)) END AS clamped_lpp
  FROM coerced),
ppp AS (
  SELECT *,
    CASE WHEN weighted_col IS NULL OR clamped_lpp IS NULL THEN NULL
         WHEN salary_usd < 2000 THEN NULL
         ELSE salary_usd * (clamped_lpp / 100.0::DOUBLE) / (weighted_col / 100.0::DOUBLE) END AS ppp_salary
  FROM clamped),
pop AS (SELECT * FROM ppp WHERE ppp_salary IS NOT NULL),
pfence AS (SELECT quantile_cont(ppp_salary, 0.25) AS q1, quantile_cont(ppp_salary, 0.75) AS q3 FROM pop),
final AS (
  SELECT pop.* FROM pop, pfence
  WHERE ppp_salary >= q1 - 1.5::DOUBLE * (q3 - q1) AND ppp_salary <= q3 + 1.5::DOUBLE * (q3 - q1))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _missing_sql(table: str, columns: list[str], with_pct: bool) -> str:
    counts = ", ".join(f'count(*) - count("{c}") AS m{i}' for i, c in enumerate(columns))
    rows = []
    for i, c in enumerate(columns):
        sel = f"SELECT '{c}' AS \"column\", m{i} AS missing"
        if with_pct:
            sel += f", {r_even(f'm{i}::DOUBLE / n::DOUBLE * 100.0::DOUBLE')} AS percentage"
        rows.append(sel + " FROM agg")
    return f"agg AS (SELECT count(*) AS n, {counts} FROM {table})\n" + "\nUNION ALL ".join(rows)


def _describe_sql(src: str) -> str:
    """``src`` is a query with one double column ``v`` (NULLs removed)."""
    stats = [("count", "count(v)::DOUBLE"), ("mean", "avg(v)"), ("std", "stddev_samp(v)"),
             ("min", "min(v)"), ("25%", "quantile_cont(v, 0.25)"), ("50%", "quantile_cont(v, 0.5)"),
             ("75%", "quantile_cont(v, 0.75)"), ("max", "max(v)")]
    return "\nUNION ALL ".join(f"SELECT '{s}' AS stat, {r_even(e)} AS value FROM ({src})"
                               for s, e in stats)


JOB_COLUMNS = ["job_id", "salary_usd", "experience_level", "years_experience", "benefits_score",
               "remote_ratio", "posting_date", "company_location"]
CITY_NUMERIC = ["Rank", "Groceries Index", "Local Purchasing Power Index"]
CITY_OTHER = ["Country", "Cost of Living Index", "Cost of Living Plus Rent Index"]
CITY_COLUMNS = ["Rank", "Country", "Cost of Living Index", "Cost of Living Plus Rent Index",
                "Groceries Index", "Local Purchasing Power Index"]


def _describe_all_sql() -> str:
    num = "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count("{c}") AS count, NULL::BIGINT AS "unique",
  NULL::VARCHAR AS top, NULL::BIGINT AS freq, avg("{c}"::DOUBLE) AS mean,
  stddev_samp("{c}"::DOUBLE) AS std, min("{c}"::DOUBLE) AS min,
  quantile_cont("{c}"::DOUBLE, 0.25) AS q25, quantile_cont("{c}"::DOUBLE, 0.5) AS q50,
  quantile_cont("{c}"::DOUBLE, 0.75) AS q75, max("{c}"::DOUBLE) AS max FROM city_costs"""
        for c in CITY_NUMERIC)
    long = "\nUNION ALL ".join(f"""SELECT '{c}' AS col, CAST("{c}" AS VARCHAR) AS v FROM city_costs"""
                               for c in CITY_OTHER)
    stats = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    rounded = ", ".join(f"{r_even(s)} AS {s}" for s in stats)
    return f"""num AS ({num}),
long AS ({long}),
freq AS (SELECT col, v, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY col, v),
strs AS (SELECT col AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
  first(v ORDER BY n DESC, v ASC) AS top, max(n) AS freq,
  NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS q25,
  NULL::DOUBLE AS q50, NULL::DOUBLE AS q75, NULL::DOUBLE AS max FROM freq GROUP BY col),
both_kinds AS (SELECT * FROM num UNION ALL SELECT * FROM strs)
SELECT "column", count, "unique", top, freq, {rounded} FROM both_kinds"""


def _corr_sql() -> str:
    cols = ["salary_usd", "years_experience", "benefits_score", "remote_ratio"]
    rows = []
    for x in cols:
        for y in cols:
            rows.append(f"SELECT '{x}' AS col_x, '{y}' AS col_y, "
                        f"{r_even(f'corr({x}::DOUBLE, {y}::DOUBLE)')} AS corr FROM jobs")
    return "\nUNION ALL ".join(rows)


def oracle_sql() -> dict[str, str]:
    r4 = lambda e: r_even(e, 4)
    trend = f"""m AS (
  SELECT strftime(posting_date, '%Y-%m') AS month, count(job_id) AS job_count,
    avg(salary_usd) AS avg_salary, avg(years_experience) AS avg_years_experience
  FROM jobs WHERE posting_date IS NOT NULL GROUP BY 1),
f AS (
  SELECT *,
    last_value(job_count::DOUBLE IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fj,
    last_value(avg_salary IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fs
  FROM m),
g AS (
  SELECT *, lag(fj) OVER (ORDER BY month) AS pj, lag(fs) OVER (ORDER BY month) AS ps FROM f)
SELECT month, job_count, {r4('avg_salary')} AS avg_salary, {r4('avg_years_experience')} AS avg_years_experience,
  {r4("(fj / nullif(pj, 0.0::DOUBLE) - 1.0::DOUBLE) * 100.0::DOUBLE")} AS job_growth,
  {r4("(fs / nullif(ps, 0.0::DOUBLE) - 1.0::DOUBLE) * 100.0::DOUBLE")} AS salary_growth
FROM g"""
    box = """b AS (SELECT experience_level AS g, salary_usd AS v FROM jobs
          WHERE experience_level IS NOT NULL AND salary_usd IS NOT NULL),
q AS (SELECT g, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75
      FROM b GROUP BY g),
f AS (SELECT *, q25 - 1.5::DOUBLE * (q75 - q25) AS lo, q75 + 1.5::DOUBLE * (q75 - q25) AS hi FROM q)
SELECT f.g AS experience_level, q25, q50, q75,
  min(CASE WHEN v >= lo AND v <= hi THEN v END) AS lo_whisker,
  max(CASE WHEN v >= lo AND v <= hi THEN v END) AS hi_whisker,
  CAST(sum(CASE WHEN v < lo OR v > hi THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
FROM b JOIN f ON b.g = f.g GROUP BY f.g, q25, q50, q75"""
    sal = "SELECT salary_usd AS v FROM jobs WHERE salary_usd IS NOT NULL AND NOT isnan(salary_usd)"
    trend = _with(JOBS) + ", " + trend
    tokens = "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
    na = "\nUNION ALL ".join(f"""SELECT '{c}' AS "column", CASE WHEN count(v) = 0 THEN 'double'
  WHEN count(*) FILTER (regexp_matches(v, '^\\s*[+-]?[0-9]+\\s*$')) = count(v) THEN 'bigint'
  WHEN count(*) FILTER (regexp_matches(v, '{NUMBER_SYNTAX}')) = count(v) THEN 'double' ELSE 'string' END AS type,
  count(*) - count(v) AS missing FROM (SELECT CASE WHEN "{c}" NOT IN ({tokens}) THEN "{c}" END AS v FROM city_costs)""" for c in CITY_OTHER)
    report_columns = ["job_id", "salary_usd", "experience_level", "remote_ratio"]
    report = "\nUNION ALL ".join(
        [f"SELECT 'missing' AS section, '{c}' AS name, (count(*) - count({c}))::DOUBLE AS value FROM jobs" for c in report_columns]
        + [f"SELECT 'salary_stats' AS section, stat AS name, value FROM ({_describe_sql(sal)})",
           """SELECT 'salary_outliers' AS section, 'rows' AS name, count(*)::DOUBLE AS value FROM jobs, f
WHERE salary_usd < q1 - 1.5::DOUBLE * (q3 - q1) OR salary_usd > q3 + 1.5::DOUBLE * (q3 - q1)""",
           "SELECT 'category_counts' AS section, experience_level AS name, count(*)::DOUBLE AS value FROM jobs WHERE experience_level IS NOT NULL GROUP BY experience_level"])
    return {
        "monthly_trend_text": trend,
        "csv_na_tokens": _with(CITY_COSTS) + na,
        "csv_scan": _with(CITY_COSTS) + """SELECT "Rank", "Country", CAST(nullif("Cost of Living Index", 'n/a') AS BIGINT) AS "Cost of Living Index",
  CAST(nullif("Cost of Living Plus Rent Index", '') AS BIGINT) AS "Cost of Living Plus Rent Index", "Groceries Index", "Local Purchasing Power Index"
FROM city_costs""",
        "sql_remote": _with(JOBS) + """SELECT remote_ratio, count(*) AS job_count, min(salary_usd) AS least, max(salary_usd) AS most
FROM jobs GROUP BY remote_ratio""",
        "optional_columns": _with(JOBS) + """SELECT 'salary_usd' AS "column", true AS present, count(salary_usd) AS non_null FROM jobs
UNION ALL SELECT 'experience_level', true, count(experience_level) FROM jobs UNION ALL SELECT 'bonus_usd', false, NULL::BIGINT""",
        "quality_report": _with(JOBS) + """, f AS (SELECT quantile_cont(salary_usd, 0.25) AS q1, quantile_cont(salary_usd, 0.75) AS q3 FROM jobs)
""" + report,
        "missing_profile": _with(JOBS, _missing_sql("jobs", JOB_COLUMNS, True)),
        "col_missing_profile": _with(CITY_COSTS, _missing_sql("city_costs", CITY_COLUMNS, False)),
        "salary_describe": _with(JOBS) + _describe_sql(sal),
        "ppp_describe": _with(JOBS, COST_LIVING, MERGED, PPP) + _describe_sql(
            "SELECT ppp_salary AS v FROM final"),
        "col_describe_all": _with(CITY_COSTS, _describe_all_sql()),
        "quantiles": _with(JOBS) + """SELECT 0.25::DOUBLE AS prob, quantile_cont(salary_usd, 0.25) AS value FROM jobs
UNION ALL SELECT 0.75::DOUBLE AS prob, quantile_cont(salary_usd, 0.75) AS value FROM jobs""",
        "iqr_outliers": _with(JOBS) + """, f AS (SELECT quantile_cont(salary_usd, 0.25) AS q1,
  quantile_cont(salary_usd, 0.75) AS q3 FROM jobs)
SELECT job_id, salary_usd FROM jobs, f
WHERE salary_usd < q1 - 1.5::DOUBLE * (q3 - q1) OR salary_usd > q3 + 1.5::DOUBLE * (q3 - q1)""",
        "iqr_filter": _with(JOBS, COST_LIVING, MERGED, PPP)
        + "SELECT job_id, company_location, salary_usd, ppp_salary FROM final",
        "experience_counts": _with(JOBS) + """SELECT experience_level, count(*) AS count FROM jobs
WHERE experience_level IS NOT NULL GROUP BY experience_level""",
        "corr_matrix": _with(JOBS) + _corr_sql(),
        "salary_box_stats": _with(JOBS) + ", " + box,
        "monthly_trend": trend,
        "top_skills": _with(SKILLS) + """, s AS (SELECT trim(unnest(string_split(required_skills, ','))) AS skill FROM skills)
SELECT skill, count(*) AS count FROM s WHERE skill != '' GROUP BY skill
ORDER BY count DESC, skill ASC LIMIT 10""",
        "top_names": """WITH l AS (SELECT 'Customer ' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ' , ' || o_orderpriority ELSE '' END
  || CASE WHEN o_orderkey % 5 = 0 THEN ',Shift ' || (o_custkey % 7) ELSE '' END AS names FROM orders),
s AS (SELECT trim(unnest(string_split(names, ','))) AS name FROM l)
SELECT name, count(*) AS count FROM s WHERE name != '' GROUP BY name ORDER BY count DESC, name ASC LIMIT 10""",
        "remote_stats": _with(JOBS) + """SELECT remote_ratio, round(avg(salary_usd), 2) AS avg_salary,
  count(*) AS job_count FROM jobs GROUP BY remote_ratio ORDER BY remote_ratio NULLS LAST""",
        "geo_top10": _with(JOBS) + """SELECT company_location, round(avg(salary_usd), 2) AS avg_salary,
  count(*) AS job_count, round(avg(remote_ratio), 2) AS avg_remote_ratio
FROM jobs GROUP BY company_location
ORDER BY avg_salary DESC NULLS LAST, company_location ASC NULLS LAST LIMIT 10""",
        "col_join": _with(JOBS, COST_LIVING, MERGED) + "SELECT * FROM merged",
        "merged_sample": _with(JOBS, COST_LIVING, MERGED) + "SELECT * FROM merged ORDER BY job_id LIMIT 6",
        "ppp_salary": _with(JOBS, COST_LIVING, MERGED, PPP) + """SELECT job_id, company_location, salary_usd,
  col_index, col_plus_rent, lpp, weighted_col, clamped_lpp, ppp_salary FROM ppp""",
        "ppp_country_ranking": _with(JOBS, COST_LIVING, MERGED, PPP) + """SELECT company_location,
  round(avg(salary_usd), 2) AS avg_nominal_salary, round(avg(ppp_salary), 2) AS avg_ppp_salary,
  count(*) AS job_count
FROM final GROUP BY company_location HAVING count(*) >= 10
ORDER BY avg_ppp_salary DESC NULLS LAST, company_location ASC LIMIT 10""",
    }
