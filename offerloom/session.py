"""Session settings the jobs are written for."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Runtime settings only: they can be applied to a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot search may hold a third of the offers: let AQE split that partition
    # of a join even when the split costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows hold whole pages: keep an Arrow batch small however long the pages are.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """Apply the bounds of Arrow batches alone; without them a batch has 10,000 rows."""
    for key in RUNTIME_CONF:
        if ".arrow.max" in key:
            spark.conf.set(key, RUNTIME_CONF[key])
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    Needed where the package is not installed on the executors; Spark distributes the archive
    like any ``--py-files`` entry.
    """
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parent
        stem = Path(tempfile.mkdtemp(prefix="offerloom-")) / "offerloom_package"
        archive = shutil.make_archive(str(stem), "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(application)
    return spark


def build_session(
    app_name: str = "offerloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Build a session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    # Rounds of iterative jobs are deleted once nothing refers to them.
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME_CONF, **extra}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())
