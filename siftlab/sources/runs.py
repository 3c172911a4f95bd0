"""Reads of the run table (partitioned by exp_id and stage)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_runs(runs: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows in the layout the scans prune on."""
    runs.write.mode(mode).partitionBy("exp_id", "stage").parquet(path)


def run_scan(runs: DataFrame, exp_id: str, stage: str | None = "judged") -> DataFrame:
    """Rows of one experiment and stage; both conditions prune partitions or reach the scan."""
    hit = F.col("exp_id") == exp_id
    return runs.where(hit & (F.col("stage") == stage) if stage else hit)


def ordered_listing(
    runs: DataFrame, exp_id: str, stage: str = "judged", order: str = "id", limit: int | None = None
) -> DataFrame:
    """Rows by id or by reward with id as tie-break; ``limit`` is the page size asked for."""
    orders = {
        "id": [F.col("id")],
        "reward_asc": [F.col("reward").asc_nulls_first(), F.col("id")],
        "reward_desc": [F.col("reward").desc_nulls_last(), F.col("id")],
    }
    out = run_scan(runs, exp_id, stage).orderBy(*orders[order])
    return out.limit(limit) if limit is not None else out


def export_experiment(runs: DataFrame, exp_id: str, path: str, limit: int | None = None) -> None:
    """Write an experiment's rows as JSON lines."""
    rows = run_scan(runs, exp_id, None).orderBy("dataset_index", "id")
    (rows.limit(limit) if limit is not None else rows).write.mode("errorifexists").json(path)


def clear_experiment(runs: DataFrame, exp_id: str) -> DataFrame:
    """The run table without one experiment; rows without an experiment stay."""
    return runs.where(~F.col("exp_id").eqNullSafe(F.lit(exp_id)))
