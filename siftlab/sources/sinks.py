"""Sinks: counted JSON lines, manifests, fingerprints, bounded parts, collection copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlab.operators.ordinals import with_ordinal
from siftlab.operators.sets import set_report


def sorted_json(df: DataFrame) -> Column:
    """Each row as JSON with keys in alphabetical order; non-ASCII text stays as it is."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))


def write_json_lines(df: DataFrame, path: str, expected: int) -> int:
    """Write key-sorted JSON lines and compare the written count with the expected one."""
    df.select(sorted_json(df).alias("value")).write.mode("errorifexists").text(path)
    written = df.sparkSession.read.text(path).count()
    if written != expected:
        raise RuntimeError(f"wrote {written} lines to {path}, expected {expected}")
    return written


def _row_digest(columns: list[str]) -> Column:
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))


def fingerprint(columns: list[str]) -> Column:
    """Order-free table fingerprint: the sum of 60-bit row digests, as an exact decimal.

    Equal tables agree whatever their files, order or partitioning; duplicates count.
    """
    bits = F.conv(F.substring(_row_digest(columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.sum(bits).cast("string")


def manifest(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Rows and fingerprint per group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), fingerprint(columns).alias("fingerprint"))


def manifest_json(df: DataFrame, group: str, columns: list[str], seed: int) -> DataFrame:
    """One row: total, seed and the per-group counts as JSON (groups are few)."""
    per_group = manifest(df, group, columns)
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(group).cast("string"), "n"))))
    return per_group.agg(
        F.to_json(F.struct(counts.alias("counts"), F.lit(seed).alias("seed"), F.sum("n").alias("total"))).alias("manifest")
    )


def count_check(lines: DataFrame, expected: DataFrame, group: str) -> DataFrame:
    """Written lines against manifest counts per group."""
    got = lines.groupBy(group).agg(F.count(F.lit(1)).alias("written"))
    return expected.join(got, group, "full_outer").select(
        group,
        F.coalesce("expected", F.lit(0)).alias("expected"),
        F.coalesce("written", F.lit(0)).alias("written"),
        (F.coalesce("expected", F.lit(0)) == F.coalesce("written", F.lit(0))).alias("matches"),
    )


def bounded_parts(df: DataFrame, order_by, max_rows: int, name: str = "part") -> DataFrame:
    """Part numbers 1, 2, ... so that no part has more than ``max_rows`` rows, in order."""
    if max_rows <= 0:
        raise ValueError("max_rows must be positive")
    return with_ordinal(df, order_by, "_i").withColumn(name, (F.floor(F.col("_i") / max_rows) + 1).cast("int")).drop("_i")


def write_parts(requests: DataFrame, request_map: DataFrame, key: str, order_by, max_rows: int, path: str) -> None:
    """Requests and the matching slice of their map, both partitioned by part."""
    parts = bounded_parts(requests, order_by, max_rows)
    parts.write.mode("errorifexists").partitionBy("part").json(f"{path}/requests")
    request_map.join(parts.select(key, "part"), key).write.mode("errorifexists").partitionBy("part").json(f"{path}/map")


def copy_report(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """What a copy would move: source rows, rows present, rows to copy, and whether that completes it."""
    report = set_report(source, target, [key])
    return report.select(
        F.col("expected").alias("source_rows"),
        F.col("got").alias("present_rows"),
        F.col("missing").alias("copied_rows"),
        (F.col("shared") + F.col("missing") == F.col("expected")).alias("complete"),
    )


def copy_collection(source: DataFrame, path: str, key: str, resume: bool = False) -> int:
    """Copy a collection; skip when complete, refuse a partial target unless ``resume``; verify counts."""
    spark = source.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    total = source.count()
    rows = source
    if exists:
        target = spark.read.schema(source.schema).parquet(path)
        present = target.count()
        if present == total:
            return 0
        if present and not resume:
            raise RuntimeError(f"{path} holds {present} rows, the source {total}; refusing to overwrite")
        rows = source.join(target.select(key), key, "left_anti")
    rows.write.mode("append").parquet(path)
    final = spark.read.parquet(path).count()
    if final != total:
        raise RuntimeError(f"{path} holds {final} rows after the copy, expected {total}")
    return total if not exists else total - present


