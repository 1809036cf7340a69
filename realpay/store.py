"""Tables that several steps read, stored in the shared folder and deleted when they are no longer needed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from realpay.session import ensure_checkpoint_dir


class Store:
    """Stored copies with a lifetime: ``with Store(spark) as store: rows = store.keep(rows, "rows")``.

    Copies are Parquet tables under the session's checkpoint folder, so a lost executor costs a read, not a
    recomputation, and none of the upstream plan runs again. Leaving the block deletes all of them, also after
    an error; frames that read one can't be used afterwards. Without a block, :meth:`close` does it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, []

    def path(self, name: str) -> str:
        """A new folder that is deleted with the store."""
        path = f"{ensure_checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self._paths.append(path)
        return path

    def keep(self, df: DataFrame, name: str = "kept") -> DataFrame:
        """Write ``df`` now and return the stored copy."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        while self._paths:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._paths.pop())
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()
