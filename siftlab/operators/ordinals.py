"""Row numbers, exact quotas and exact order statistics that no single task has to hold.

A plain ``row_number`` over a group sends the whole group to one task, and over no group sends
the whole table there. These helpers range-partition instead and add per-partition offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlab.operators.keys import null_safe_join
from siftlab.session import materialize

_LOCAL_BITS = 33


def _as_list(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def with_ordinal(df: DataFrame, order_by, name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given order.

    The order must be total (end it with an id). Rows are range-partitioned and numbered inside
    their partition; the offsets come from one count per partition.
    """
    keys = _as_list(order_by)
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    numbered = ranged.sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    stored = materialize(
        numbered.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS)).withColumn(
            "_local", F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)
        ).drop("_mid"),
        "ordinal",
    )
    sizes = stored.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range partition: a few thousand at most, so a single window task is enough.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        stored.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_pid", "_local", "_offset")
    )


def with_group_ordinal(
    df: DataFrame, by, order_by, name: str = "ordinal", partitions: int | None = None
) -> DataFrame:
    """Number rows 0, 1, 2, ... inside each group; a group may span any number of tasks."""
    groups = _as_list(by)
    numbered = with_ordinal(df, [*[F.col(g) for g in groups], *_as_list(order_by)], "_global", partitions)
    first = numbered.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]).agg(
        F.min("_global").alias("_first")
    )
    matched = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    return (
        numbered.join(first, matched, "left")
        .withColumn(name, F.col("_global") - F.col("_first"))
        .drop("_global", "_first", *[f"_g{i}" for i in range(len(groups))])
    )


def hash_key(seed: object, *cols) -> Column:
    """Seeded, engine-independent order key: the hex digest of ``seed|col|col``."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)


def take_quota(df: DataFrame, by, digest: str, tie: str, quota, digits: int = 3) -> DataFrame:
    """The first ``quota`` rows of every group in (digest, tie) order, exactly.

    ``digest`` is a uniform hex string. Counts per (group, leading digits) tell how many rows each
    bucket still gives, so rows are ranked inside small buckets and later buckets are dropped early.
    ``quota`` is an int or the name of a column that is constant inside the group.
    """
    groups = _as_list(by)
    bucketed = df.withColumn("_b", F.substring(digest, 1, digits))
    wanted = F.col(quota) if isinstance(quota, str) else F.lit(int(quota))
    counts = bucketed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"), F.max(wanted).alias("_quota"))
    # At most 16**digits rows per group.
    earlier = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where("_before < _quota")
    cut = cut.select(*groups, "_b", (F.col("_quota") - F.col("_before")).alias("_room"))
    inside = Window.partitionBy(*groups, "_b").orderBy(digest, tie)
    ranked = null_safe_join(bucketed, cut, [*groups, "_b"]).withColumn("_rn", F.row_number().over(inside))
    return ranked.where("_rn <= _room").drop("_b", "_room", "_rn")


def exact_quantiles(df: DataFrame, by, value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group without holding a group in memory.

    Equal values are merged first. The distinct values are then range-partitioned, and the
    running counts of all partitions are used to pick the values at the two positions each
    quantile needs.
    """
    groups = _as_list(by)
    merged = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    keys = [*groups, value]
    ranged = merged.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = materialize(ranged.withColumn("_pid", F.spark_partition_id()), "quantile")
    part = stored.groupBy(*groups, "_pid").agg(F.sum("_c").alias("_s"))
    earlier = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    part = part.select(
        *groups,
        "_pid",
        F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_s").over(whole).alias("_total"),
    )
    inside = Window.partitionBy(*groups, "_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = null_safe_join(stored, part, [*groups, "_pid"]).withColumn(
        "_hi", F.col("_offset") + F.sum("_c").over(inside)
    ).withColumn("_lo", F.col("_hi") - F.col("_c"))
    aggs = []
    for label, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.floor(pos), F.ceil(pos)
        at_low = F.max(F.when((F.col("_lo") <= low) & (low < F.col("_hi")), F.col(value)))
        at_high = F.max(F.when((F.col("_lo") <= high) & (high < F.col("_hi")), F.col(value)))
        weight = F.max(pos - low)
        aggs.append((at_low + (at_high - at_low) * weight).alias(label))
    return placed.groupBy(*groups).agg(*aggs)


def top_per_group(df: DataFrame, by, order_by, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group for a small ``n``.

    Spark prunes to ``n`` rows per group before the shuffle (window group limit), so a hot group
    sends at most ``n`` rows from each task.
    """
    window = Window.partitionBy(*_as_list(by)).orderBy(*_as_list(order_by))
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def best_per_group(df: DataFrame, by, order: list[Column]) -> DataFrame:
    """The single first row per group, as a combinable ``min`` over a struct (no window)."""
    groups = _as_list(by)
    payload = F.struct(*[F.col(c) for c in df.columns])
    picked = df.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]).agg(
        F.min_by(payload, F.struct(*order)).alias("_row")
    )
    return picked.select("_row.*")
