"""The given Parquet tables (one file or directory per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from realpay.functions.numbers import nan_to_null

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


#: Schemas of the tables that the report's inputs derive from: naming them saves the job that reads a file's footer.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan; projections and filters written later reach the
    scan (``ReadSchema`` / ``PushedFilters``)."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(table_path(sf_dir, name))


def nan_as_null(df: DataFrame) -> DataFrame:
    """``df`` with NaN turned into NULL in every float column: the library has one missing value."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floats}) if floats else df


def sql_over(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """Run ``query`` over ``frames``, which it names in braces: ``sql_over(spark, "SELECT * FROM {costs}", costs=df)``.

    The names belong to this query alone: the session's views stay as they are, and two queries may use one name for
    different frames.
    """
    before = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    missing = [n for n in frames if "{" + n + "}" not in query]
    if missing:
        raise ValueError(f"the query does not name {', '.join(missing)}")
    out = spark.sql(query, **frames)
    for view in {t.name for t in spark.catalog.listTables() if t.isTemporary} - before:
        spark.catalog.dropTempView(view)
    return out


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the tables as temporary views (``con.register`` in SQL terms).

    Spark looks for them, wherever they are; a table that is not there is an error.
    """
    for name in names:
        load_table(spark, sf_dir, name).createOrReplaceTempView(name)
