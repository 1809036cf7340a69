"""Reading the given tables and storing intermediate ones in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="realpay-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """``name``.parquet of ``sf_dir``, only ``columns`` if any are named."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the cluster's ``spark.checkpoint.dir``.

    Where that setting is absent, a folder set with ``setCheckpointDir`` is used; a local session without
    either gets a new temporary one. A cluster without either is an error: its executors share no folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="realpay-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{sc.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage: after a lost executor only the readers of the table run again, not what made it. The table
    stays until :func:`clear` or until the cluster clears its checkpoint folder.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application stored. Results that still read it can't be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of keys that are sent to all tasks at most.
SENT_BYTES = 32 << 20


def without(docs: DataFrame, keys: dict, rejected: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` (name to column; null equals nothing) are no row of ``rejected``, which has
    columns of these names, none of them wide.

    The rejected keys are stored and, while they come to at most :data:`SENT_BYTES`, sent to all tasks, so that
    texts need not move; beyond that Spark joins by a shuffle.
    """
    named = {name: f"_rp_{name}" for name in keys}
    rejected = stored(rejected.select(*(F.col(name).alias(own) for name, own in named.items())).distinct(), "rejected")
    rejected = F.broadcast(rejected) if rejected.count() * 16 * len(keys) <= SENT_BYTES else rejected
    on = [key == F.col(named[name]) for name, key in keys.items()]
    return docs.join(rejected, on, "left_anti")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(column: str):
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
