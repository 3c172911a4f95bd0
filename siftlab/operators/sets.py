"""Set operations on frames and key arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_streams(*frames: DataFrame) -> DataFrame:
    """All rows of all frames by column name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_difference(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys on one side only, marked ``missing`` (expected only) or ``extra``."""
    e, g = expected.select(*keys).distinct(), got.select(*keys).distinct()
    return e.join(g, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(
        g.join(e, keys, "left_anti").withColumn("side", F.lit("extra"))
    )


def distinct_first(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row per key with the position of its first occurrence; sort by it for the kept order."""
    return df.groupBy(*keys).agg(F.min(position).alias(position))


def set_report(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of both key sets, of their overlap and differences, and whether they are equal.

    One full pass: every row is tagged by side and grouped by key, so no join is needed.
    """
    tagged = expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_g")).unionByName(
        got.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_g"))
    )
    sides = tagged.groupBy(*keys).agg(F.max("_e").alias("e"), F.max("_g").alias("g"))
    return sides.agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("expected"),
        F.coalesce(F.sum("g"), F.lit(0)).alias("got"),
        F.count_if((F.col("e") == 1) & (F.col("g") == 1)).alias("shared"),
        F.count_if(F.col("g") == 0).alias("missing"),
        F.count_if(F.col("e") == 0).alias("extra"),
    ).withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))


def assert_disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """Raise when the two frames share a key."""
    shared = a.select(*keys).join(b.select(*keys), keys, "left_semi").take(1)
    if shared:
        raise ValueError(f"frames overlap on {keys}: {shared[0].asDict()}")
