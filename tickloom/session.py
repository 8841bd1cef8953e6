"""Session settings, and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every job here relies on: UTC wall time, string partition
# values, and partition-scoped overwrites.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split the rows of a hot key in a join even where that costs another shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Parts of a shuffle are joined up to this size only, and scans are cut at it for the
    # aggregates behind them, so that what a task holds does not grow with the input.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "16m",
    # The JVM does not optimise methods above this size; Spark then compiles the
    # operators of the stage one by one instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}

# Shuffles are cut into so many parts before small ones are joined, or into as many as the
# session asks for. Up to 200 Spark writes them without sorting them in memory first.
LEAST_PARTITIONS = 200
PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

_local_scratch: dict[str, str] = {}
_scratch_folders: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that someone else created."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(PARTITIONS, str(max(LEAST_PARTITIONS, asked)))
    return spark


def build_session(
    app_name: str = "tickloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings above; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME_SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def _base(spark: SparkSession) -> str:
    """The shared folder that the cluster names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder all executors can reach")
    if context.applicationId not in _local_scratch:
        _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="tickloom-")
    return _local_scratch[context.applicationId]


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path for a written table, under the folder the cluster names.

    ``spark.checkpoint.dir`` is that folder. A temporary folder of this machine
    is used only in local mode, where driver and executors are one process. All such
    tables of an application are in one folder, which goes when the driver ends.
    """
    own = f"{_base(spark)}/tickloom-{spark.sparkContext.applicationId}"
    if own not in _scratch_folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _scratch_folders.add(own)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
