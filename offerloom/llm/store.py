"""Tables written to the shared folder between the rounds of a job.

The folder is the one the session names in ``spark.checkpoint.dir``. Where that is unset, a local
session, as in tests, uses the warehouse; on a cluster the setting is asked for. A job's tables are deleted
when the application ends, and earlier when the job drops them.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "_offerloom_llm"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that hold whole texts and go to Python together.
BATCH_ROWS = 512


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def modest_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small: a batch of whole texts is held several times over."""
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


class Workspace:
    """A job's own folder below the shared one."""

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/{_FOLDER}/{job}-{uuid.uuid4().hex}"
        path = self._path(self.root)
        # Only a folder that is there can be marked for deletion.
        self._fs().mkdirs(path)
        self._fs().deleteOnExit(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return self._path(self.root).getFileSystem(conf)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the written rows: lineage ends here."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later round reads."""
        self._fs().delete(self._path(f"{self.root}/{name}"), True)
