"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# settings every job relies on: UTC so epoch arithmetic never shifts, AQE so
# shuffle partitions coalesce and skewed joins split at run time
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def ensure(spark: SparkSession) -> SparkSession:
    """Pin the settings the engine's arithmetic depends on (idempotent)."""
    for key, value in _REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


#: rows of the events behind one shuffle partition, before small ones are put together
ROWS_PER_PARTITION = 50_000
# most MB of shuffled (compressed) data that small partitions are put together to, and that a join's partition holds unsplit
_MOST_MB = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 8, "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 32}


def _bytes(setting: str) -> int:
    digits = setting.lower().rstrip("bkmgtp")
    unit = setting.lower()[len(digits):].rstrip("b")
    return int(digits) << (10 * (" kmgtp".index(unit) if unit else 0))


def sized(spark: SparkSession, rows: int) -> SparkSession:
    """Let shuffles start with partitions in proportion to `rows`, so that what a task holds does not grow with them.

    Few rows keep the session's own numbers. Adaptive execution puts small
    partitions together again, and splits a join's partition where one key has
    many rows, by the sizes of `_MOST_MB` or smaller ones of the session.
    """
    wanted = max(-(-rows // ROWS_PER_PARTITION), int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    for key, mb in _MOST_MB.items():
        if _bytes(spark.conf.get(key)) > mb << 20:
            spark.conf.set(key, f"{mb}m")
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "peakview") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the cluster's."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PEAKVIEW_DRIVER_MEMORY", "16g"))
        .config("spark.buffer.pageSize", "2m")  # small questions: no 64 MB page per aggregation
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    for key, value in _REQUIRED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure(spark)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in tasks are pickled by reference, so a worker must be
    able to import the package even where it is installed on the driver only.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="peakview-ship-"), "peakview_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("peakview", os.path.relpath(full, top)))
    context.addPyFile(path)  # the driver serves it; executors fetch their own copy
    _shipped.add(context.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Only on a local master may it be unset (tests, bench): then a scratch
    folder is made. Elsewhere a driver-local folder would be lost to the
    executors, so this raises.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="peakview-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: what reads it later reads files, not the plan behind it."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
