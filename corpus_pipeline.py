"""From raw documents to packed training windows, stage by stage.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns the rows it keeps, which
are written and read again as the next one's ``docs``. ``run`` applies all of them to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from realpay.llm import decontaminate, packing, pii, quality, simhash
from realpay.llm.tables import stored, table


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_text),
    ("simhash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("pii", without_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the language model, the fingerprints or the tokens; tests hold ``run`` against plain Python.
ORACLE_SQL = None

PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_SQL: dict[str, str] = {}
