"""JSON-lines scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siftlab.functions import fixed as K
from siftlab.functions.text import lookup, strip


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with the name of their file."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line"))


def line_kind(line: Column) -> Column:
    """``blank``, ``corrupt``, ``other`` (valid JSON that is no object) or ``object``."""
    parsed = F.try_parse_json(line)
    return (
        F.when(line == "", "blank")
        .when(parsed.isNull(), "corrupt")
        .when(~line.startswith("{"), "other")
        .otherwise("object")
    )


def tagged_records(
    lines: DataFrame, schema: str | T.StructType, file_tasks: dict[str, str] | None = None, strict: bool = True
) -> DataFrame:
    """Parsed objects with task_type by file name.

    Blank lines and non-objects are dropped. A corrupt line fails the job with its file and text
    when ``strict``; otherwise it is kept with ``corrupt`` set, for a quarantine table.
    """
    trimmed = lines.withColumn("line", strip("line")).withColumn("kind", line_kind(F.col("line")))
    wanted = trimmed.where(F.col("kind").isin("object", "corrupt"))
    record = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    bad = F.col("kind") == "corrupt"
    if strict:
        message = F.concat(F.lit("Invalid JSON in "), F.col("file_name"), F.lit(": "), F.substring("line", 1, 200))
        record = F.when(bad, F.raise_error(message)).otherwise(record)
    tasks = lookup("file_name", file_tasks or K.FILE_TASKS)
    return wanted.select("file_name", tasks.alias("task_type"), record.alias("record"), bad.alias("corrupt"), "line")


def line_report(lines: DataFrame, file_tasks: dict[str, str] | None = None) -> DataFrame:
    """Lines per task and kind."""
    kinds = lines.select(
        lookup("file_name", file_tasks or K.FILE_TASKS).alias("task_type"), line_kind(strip("line")).alias("kind")
    )
    return kinds.groupBy("task_type", "kind").agg(F.count(F.lit(1)).alias("n"))
