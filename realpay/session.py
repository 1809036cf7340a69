"""Session settings the operators rely on.

The library never creates its own cluster settings behind the caller's back,
except for the few SQL settings whose values change results:

* ``spark.sql.ansi.enabled=true``: bad casts and overflows raise; operators use
  ``try_*`` functions where a NULL is the intended answer.
* ``spark.sql.session.timeZone=UTC``: month labels never shift with the
  driver's zone.

Checkpoints go to the directory the cluster names in ``spark.checkpoint.dir``;
only when that is unset (tests, a laptop) is a directory chosen here.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

RESULT_SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Scale settings: AQE re-plans joins from runtime sizes, coalesces small shuffle
# partitions and splits skewed join partitions (a hot key may hold a third of
# the rows).
SCALE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the result-affecting SQL settings to an existing session."""
    for key, value in RESULT_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in SCALE_SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, choosing one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a folder every executor can reach "
                "(HDFS/S3/shared storage); a machine-local folder cannot hold checkpoints on a cluster")
        # Local runs and tests only: a cluster names a shared folder itself.
        configured = tempfile.mkdtemp(prefix="realpay-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "realpay", extra: dict | None = None) -> SparkSession:
    """Session builder for scripts and tests (the UI stays off)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            # stored copies written by materialize()/checkpoint() are removed
            # once the frames that use them are garbage-collected
            "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
            **RESULT_SETTINGS, **SCALE_SETTINGS}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def cluster_settings(input_bytes: int, total_cores: int, shuffle_fraction: float = 0.1,
                     target_partition_bytes: int = 128 * 1024 ** 2) -> dict[str, str]:
    """Partition sizing for a large run, from the input size and the cores.

    * scan splits of 256 MiB (the operators read a few columns, so a split
      decodes to far less than its on-disk size);
    * enough shuffle partitions that the shuffled bytes (estimated as
      ``shuffle_fraction`` of the input: projections are narrow and most
      aggregates combine map-side) come to ``target_partition_bytes`` each,
      never fewer than two per core; AQE then coalesces small ones;
    * a partition is treated as skewed above four times the target (AQE
      splits it in joins).

    At 100 TB on 8,000 cores: 81,920 shuffle partitions of ~128 MiB.
    """
    shuffled = max(int(input_bytes * shuffle_fraction), 1)
    partitions = max(2 * int(total_cores), -(-shuffled // target_partition_bytes))
    return {
        # context-level (set when the session starts): stored copies written by
        # materialize() are deleted once nothing references them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 ** 2),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }
