"""Cutting lineage in iterative jobs with reliable checkpoints."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Without the setting a local session takes one beside its warehouse. On a cluster that could be
    a folder of the driver's machine alone, so the setting is asked for.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = configured or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_offerloom_rounds"


def run_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, deleted when the application ends."""
    name = f"{checkpoint_root(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # Only a folder that is there can be marked for deletion.
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return name


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of ``path`` whose job ended; none where there is no folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    marks = fs.globStatus(folder.suffix("/*/_SUCCESS"))
    return sorted(mark.getPath().getParent().getName() for mark in marks)


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder so that later rounds start from them."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint()
