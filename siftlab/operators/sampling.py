"""Balanced, document-disjoint and ordered samples.

Random draws are replaced by a seeded digest order: deterministic, balanced and computed in
parallel. Quotas are exact and raise when a group is too small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from siftlab.operators.keys import null_safe_join
from siftlab.operators.ordinals import best_per_group, hash_key, take_quota, with_group_ordinal, with_ordinal
from siftlab.session import materialize


def _group_counts(df: DataFrame, group: str) -> dict:
    """Rows per group. The caller asks for a quota of each group, so the groups are a list it can hold."""
    return {r[0]: r[1] for r in df.groupBy(group).count().collect()}


def balanced_sample(df: DataFrame, group: str, id_col: str, per_group: int, seed: object, strict: bool = True) -> DataFrame:
    """``per_group`` rows of every group in seeded digest order."""
    if per_group <= 0:
        raise ValueError("per_group must be positive")
    if strict:
        short = df.groupBy(group).count().where(F.col("count") < per_group).take(10)
        if short:
            raise ValueError(f"not enough rows for {group}: {dict(map(tuple, short))}, need {per_group}")
    hashed = df.withColumn("_h", hash_key(seed, group, id_col))
    return take_quota(hashed, group, "_h", id_col, per_group).drop("_h")


def check_source(df: DataFrame, group: str, id_col: str, expected_groups) -> None:
    """Raise unless the groups are exactly the expected ones and ids are unique."""
    wanted = df.sparkSession.createDataFrame([(g,) for g in expected_groups], df.select(group).schema).distinct()
    got = df.select(group).distinct()
    missing = [r[0] for r in null_safe_join(wanted, got, group, "left_anti").take(20)]
    extra = [r[0] for r in null_safe_join(got, wanted, group, "left_anti").take(20)]
    if missing or extra:
        raise ValueError(f"missing={sorted(missing, key=str)}, extra={sorted(extra, key=str)}")
    double = df.groupBy(id_col).count().where("count > 1").take(1)
    if double:
        raise ValueError(f"duplicate {id_col}: {double[0][0]}")


def exclude_earlier(df: DataFrame, earlier: DataFrame, id_col: str, doc_col: str) -> DataFrame:
    """Rows whose id and whose document both do not occur in ``earlier``."""
    kept = df.join(earlier.select(id_col).distinct(), id_col, "left_anti")
    return kept.join(earlier.select(doc_col).distinct(), doc_col, "left_anti")


def _document_pool(df: DataFrame, group: str, doc: str, id_col: str, seed: object) -> DataFrame:
    """One row per (group, document): the first in digest order. No other row can be chosen."""
    hashed = df.withColumn("_h", hash_key(seed, group, id_col))
    return materialize(best_per_group(hashed, [group, doc], [F.col("_h"), F.col(id_col)]), "pool")


def _allocate(
    df: DataFrame, group: str, doc: str, id_col: str, quotas: dict[str, int], seed: object, scarcity: dict, strict: bool
) -> DataFrame:
    order = sorted(scarcity, key=lambda g: (scarcity[g], str(g)))
    pool = _document_pool(df, group, doc, id_col, seed)
    total = sum(quotas.values())
    parts: list[DataFrame] = []
    for g in order:
        rows = pool.where(F.col(group).eqNullSafe(F.lit(g)))
        if parts:
            used = reduce(lambda a, b: a.unionByName(b), [done.select(doc) for done in parts])
            rows = null_safe_join(rows, used, doc, "left_anti")
        # Earlier picks are written tables, so every step starts from a scan.
        chosen = materialize(take_quota(rows, group, "_h", id_col, total), "allocation")
        if strict:
            n = chosen.count()
            if n != total:
                raise ValueError(f"not enough article-disjoint rows for {g}: {n}/{total}")
        parts.append(chosen)
    picked = reduce(lambda a, b: a.unionByName(b), parts)
    # Within a group the first quota takes the first rows in digest order, the next one the next.
    ranked = with_group_ordinal(picked, group, ["_h", id_col], "_k")
    split, upto = F.lit(None).cast("string"), total
    for name, quota in reversed(list(quotas.items())):
        upto -= quota
        split = F.when(F.col("_k") < upto + quota, name).otherwise(split) if upto + quota < total else F.lit(name)
    return ranked.withColumn("split", split).drop("_k", "_h")


def disjoint_sample(
    df: DataFrame, group: str, doc: str, id_col: str, per_group: int, seed: object, strict: bool = True
) -> DataFrame:
    """``per_group`` rows per group, no document twice anywhere; scarce groups choose first.

    Scarcity is the number of distinct documents of a group. Only group names and counts reach
    the driver; each step is one parallel job.
    """
    docs = df.select(group, doc).distinct()
    scarcity = _group_counts(docs, group)
    return _allocate(df, group, doc, id_col, {"sample": per_group}, seed, scarcity, strict).drop("split")


def disjoint_split(
    df: DataFrame, group: str, doc: str, id_col: str, train: int, validation: int, seed: object, strict: bool = True
) -> DataFrame:
    """Train and validation rows per group with disjoint documents; scarce groups (rows) first."""
    quotas = {"train": train, "validation": validation}
    return _allocate(df, group, doc, id_col, quotas, seed, _group_counts(df, group), strict)


def round_robin(df: DataFrame, group: str, order_by, group_order: list | None = None, name: str = "position") -> DataFrame:
    """Interleave groups so that every prefix is balanced; rows without a group come first.

    Groups cycle in ``group_order``, further ones follow sorted; all positions come from one
    distributed sort, whatever the number of groups.
    """
    given = F.coalesce(*[F.when(F.col(group) == F.lit(g), F.lit(i)) for i, g in enumerate(group_order or [])], F.lit(2**31 - 1))
    ranked = with_group_ordinal(df, group, order_by, "_k").withColumn("_slot", given)
    return with_ordinal(ranked, [F.col(group).isNotNull(), "_k", "_slot", group], name).drop("_k", "_slot")


def replicate(df: DataFrame, k: int, name: str = "attempt") -> DataFrame:
    """Every row ``k`` times, numbered 1..k."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(k))))


def batch_slice(df: DataFrame, order_by, batch: int, batch_size: int, k: int = 1, stage: str | None = None) -> DataFrame:
    """Rows [batch*k*size, (batch+1)*k*size) in order; the stage filter applies after slicing."""
    width = k * batch_size
    rows = with_ordinal(df, order_by, "_i").where(
        (F.col("_i") >= batch * width) & (F.col("_i") < (batch + 1) * width)
    ).drop("_i")
    return rows.where(F.col("stage") == stage) if stage else rows


def batch_numbers(df: DataFrame, order_by, batch_size: int, k: int = 1, name: str = "batch") -> DataFrame:
    """Batch number of every row in order."""
    return with_ordinal(df, order_by, "_i").withColumn(name, F.floor(F.col("_i") / (k * batch_size))).drop("_i")


def shuffled_prefix(df: DataFrame, index: str, n: int, seed: object) -> DataFrame:
    """The first ``n`` rows by index in seeded digest order."""
    return df.orderBy(index).limit(n).withColumn("_h", hash_key(seed, index)).orderBy("_h").drop("_h")


def retain_last(df: DataFrame, order_by, n: int) -> DataFrame:
    """The newest ``n`` rows."""
    return df.orderBy(*order_by).limit(n)


def complete_pairs(df: DataFrame, id_col: str, kind: str, required: list) -> DataFrame:
    """Rows of ids that occur with every required kind."""
    flags = [F.max((F.col(kind) == F.lit(r)).cast("int")).alias(f"_{i}") for i, r in enumerate(required)]
    whole = df.groupBy(id_col).agg(*flags).where(" AND ".join(f"_{i} = 1" for i in range(len(required))))
    return df.join(whole.select(id_col), id_col, "left_semi")
