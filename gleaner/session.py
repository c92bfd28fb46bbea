"""Session set-up and the shared folder for tables that must outlive executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_DIRS: dict[str, str] = {}
#: Bytes of a row group of stages with wide rows, and of a batch of texts that is sent to a Python worker.
WIDE_BYTES = 16 << 20
#: Options of a Parquet writer for rows of some MB: the size of a row group is looked at after each row, not first after a hundred.
WIDE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(WIDE_BYTES)}


def get_session(app_name: str = "gleaner", master: str | None = None,
                shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """Session with UTC, AQE and skew-join handling on.

    On a cluster leave the last three unset: spark-submit supplies master and memory, and AQE
    coalesces from ``spark.sql.adaptive.coalescePartitions.initialPartitionNum``. In local mode
    the driver's memory is the memory of all tasks.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    A session without the setting gets a temporary folder, which is only right on one machine, so
    it is refused for any master other than local.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(_LOCAL_DIRS[app])
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a stage that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While a stage of whole texts is written, a batch holds ``WIDE_BYTES`` at most (or one row), less where the session says so."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_before = spark.conf.get(key, None)
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(set_before) if set_before else -1
    if 0 < held <= WIDE_BYTES:
        yield
        return
    spark.conf.set(key, str(WIDE_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, set_before) if set_before else spark.conf.unset(key)
