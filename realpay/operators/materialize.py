"""Cut lineage before multi-pass work with a reliable checkpoint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from realpay.session import ensure_checkpoint_dir


def materialize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Store ``df`` (narrowed to ``columns``) and return the stored copy.

    For inputs that are dear to compute (a join) and read more than once: the
    upstream plan runs once instead of once per pass, and a lost executor
    costs a re-read of the stored rows. Written to the session's checkpoint
    directory; Spark deletes it once unreferenced when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df.select(*columns) if columns else df).checkpoint(eager=True)
