"""Session construction and lineage cutting in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Largest number of bytes a frame may be estimated at before it is no longer broadcast by hint.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(app: str = "siftlab", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution, UTC time and skew handling switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    settings.update({key: str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors reach. The cluster names it; a local run gets its own."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="siftlab-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application for later removal."""
    return f"{shared_dir(spark)}/siftlab/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Used where a later step must see exactly the rows, row order ids or sampled partition
    bounds of an earlier evaluation. The table survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Input of one task of CPU-heavy row work.
SPREAD_BYTES = 4 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan out for CPU-heavy row work: one task per core at least, and one per 4 MB of files.

    The number of splits says little: a file is cut at its row groups only, so that splits can be
    empty and a task can hold a million rows, however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-plan_size_bytes(df) // SPREAD_BYTES))
    return df.repartition(wanted)


# The optimizer's default for frames it knows nothing about is far above this.
UNKNOWN_BYTES = 1 << 60


def measured(df: DataFrame, label: str, limit: int | None = None) -> tuple[DataFrame, int]:
    """The frame and its size in bytes.

    The size is the optimizer's estimate; where that is unknown, or above ``limit`` and so worth
    checking, the frame is written first and its files are the size.
    """
    size = plan_size_bytes(df)
    if size >= UNKNOWN_BYTES or (limit is not None and size > limit):
        df = materialize(df, label)
        size = plan_size_bytes(df)
    return df, size


def plan_size_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, the figure Spark itself uses to decide on broadcasts."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
