"""Incremental jobs: stage progress, index builds, feedback rounds, cached results, snapshots.

Every sink is a folder of Parquet tables written by ``foreachBatch``. A batch is written below
``batch=<id>`` with overwrite, so a batch that runs again after a failure replaces its own rows
and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siftlab.operators.ordinals import best_per_group

STAGES = ("init", "rollout", "judged")


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, max_files: int | None = None) -> DataFrame:
    """Stream of the Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stream of a Parquet table that is one file or a folder of files."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
        return file_stream(spark, path, schema)
    folder, _, name = path.rpartition("/")
    return file_stream(spark, folder, schema, pattern=name)


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_sink(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of all batches written so far; an empty frame before the first one."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, handle) -> None:
    """Process what has arrived and stop. ``handle(batch, batch_id)`` gives the rows to store."""

    def store(batch: DataFrame, batch_id: int) -> None:
        handle(batch, batch_id).write.mode("overwrite").parquet(_batch_path(path, batch_id))

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def earlier_rows(spark: SparkSession, path: str, schema, batch_id: int) -> DataFrame:
    """Rows of the batches before this one; what a failed run of the same batch left is not seen."""
    return (
        read_sink(spark, path, schema)
        .withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)/", 1).cast("bigint"))
        .where(F.col("_batch") < batch_id)
        .drop("_batch")
    )


def append_missing(
    stream: DataFrame, path: str, checkpoint: str, key: str, order: str, transform=lambda df: df, sink_schema=None
) -> None:
    """Incremental index: only keys the sink does not hold yet are transformed and appended.

    Of several rows with a key in one batch the first by ``order`` is taken.
    """
    schema = sink_schema or stream.schema

    def handle(batch: DataFrame, batch_id: int) -> DataFrame:
        fresh = best_per_group(batch, key, [F.col(order)])
        if batch_id > 0 and _exists(batch.sparkSession, path):
            known = earlier_rows(batch.sparkSession, path, schema, batch_id).select(key)
            fresh = fresh.join(known, key, "left_anti")
        return transform(fresh)

    run_available(stream, path, checkpoint, handle)


def stage_rank(c="stage") -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col == "judged", 2).when(col == "rollout", 1).otherwise(0)


def current_stage(log: DataFrame, key: str, tie: str) -> DataFrame:
    """Furthest stage per row, the newest entry in ties: the state a table of stage updates stands for."""
    return best_per_group(log, key, [-stage_rank(), -F.col(tie)])


def pending(log: DataFrame, key: str, tie: str, stage: str) -> DataFrame:
    """Rows a step still has to process: those whose current stage is the one before ``stage``."""
    before = STAGES[STAGES.index(stage) - 1]
    return current_stage(log, key, tie).where(F.col("stage") == before)


def reusable_results(cache: DataFrame, keys: list[str], timestamp: str, now, expire_seconds: int | None, tie: str) -> DataFrame:
    """Newest unexpired result per key; reuse holds while ``now - timestamp < expire``."""
    ts = F.col(timestamp).cast("timestamp")
    at = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    alive = cache
    if expire_seconds is not None:
        alive = cache.where(F.unix_micros(at) - F.unix_micros(ts) < expire_seconds * 1_000_000)
    return best_per_group(alive, keys, [-F.unix_micros(ts), F.col(tie)])


def cache_key(function: str | Column, args: Column) -> Column:
    """Digest of a function name and its arguments."""
    name = F.lit(function) if isinstance(function, str) else function
    return F.md5(F.concat_ws("|", name, args))


def first_results(stream: DataFrame, keys: list[str], timestamp: str, horizon: str) -> DataFrame:
    """Stream of the first result per key within the horizon; later repeats are served from it."""
    return stream.withWatermark(timestamp, horizon).dropDuplicatesWithinWatermark(keys)


def write_snapshot(notes: DataFrame, path: str, experiment: str, step: int) -> None:
    """Full note set of one experiment step; writing the step again replaces it."""
    notes.write.mode("overwrite").parquet(f"{path}/experiment={experiment}/step={step}")


def write_snapshots(notes: DataFrame, path: str) -> None:
    """Full note sets of many steps in one job, from rows with experiment and step.

    Steps that have rows here are replaced, all others stay as they are.
    """
    writer = notes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("experiment", "step").parquet(path)


def read_snapshots(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stored snapshots; a filter on experiment or step prunes folders."""
    return spark.read.schema(schema).parquet(path)


def latest_snapshot(snapshots: DataFrame, experiment: str = "experiment", step: str = "step") -> DataFrame:
    """All rows of the highest step per experiment."""
    last = snapshots.groupBy(experiment).agg(F.max(step).alias(step))
    return snapshots.join(last, [experiment, step], "left_semi")
