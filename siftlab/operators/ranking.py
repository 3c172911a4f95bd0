"""Rankings: configurations, tasks by grade, quota mixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.text import strip, text_or_empty
from siftlab.operators.ordinals import with_group_ordinal


def best_configuration(reports: DataFrame, order: list[Column], required_tasks: int = len(K.TASKS)) -> DataFrame:
    """The first report in lexicographic order among those that cover every task."""
    return reports.where(F.col("tasks") == required_tasks).orderBy(*order).limit(1)


def grade_rank(c) -> Column:
    """4 for the best grade down to 0; -1 for anything else."""
    text = F.lower(strip(text_or_empty(c)))
    out = F.lit(-1)
    for rank, grade in zip(range(4, -1, -1), K.GRADES):
        out = F.when(text == grade.lower(), rank).otherwise(out)
    return out


def rank_tasks(items: DataFrame, by: list[str], position: str = "pos") -> DataFrame:
    """Order items by grade, then by having a metric, errors last, input order in ties.

    ``by`` names one ranking. Every item gets a rank, so the ranks come from range partitions and
    a ranking may have any size. Adds ``rank`` and ``normalized_score``.
    """
    failed = strip(text_or_empty("error")) != ""
    grade = F.when(failed, F.lit(-1)).otherwise(grade_rank("grade"))
    has = F.when(failed, F.lit(0)).otherwise(F.col("metric_value").isNotNull().cast("int"))
    ranked = items.withColumn("_g", grade).withColumn("_h", has)
    raw = grade_rank("grade")
    numbered = with_group_ordinal(ranked, by, [F.desc("_g"), F.desc("_h"), F.col(position)], "_k")
    return (
        numbered.withColumn("rank", (F.col("_k") + 1).cast("int"))
        .withColumn("normalized_score", F.when(raw >= 0, raw / 4.0))
        .drop("_g", "_h", "_k")
    )


def top_tasks(items: DataFrame, by: list[str], k: int, position: str = "pos") -> DataFrame:
    """First ``k`` scored items, filled with unscored ones; items with an error are never taken."""
    usable = items.where(strip(text_or_empty("error")) == "")
    scored = F.col("metric_value").isNotNull() & (grade_rank("grade") >= 0)
    tiered = usable.withColumn("_tier", F.when(scored, 0).otherwise(1)).withColumn("_g", grade_rank("grade"))
    has = F.col("metric_value").isNotNull().cast("int")
    order = Window.partitionBy(*by).orderBy("_tier", F.desc("_g"), has.desc(), F.col(position))
    return tiered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_tier", "_g")


def quota_mix(sources: list[tuple[DataFrame, int | None]], by: list[str], key: str, k: int) -> DataFrame:
    """Mix ranked sources under quotas: each source gives its first rows in turn, ``k`` in total.

    ``sources`` holds (frame with a ``rank`` column, quota). After the quotas the rest of the
    sources fills up in the same order. A key taken by an earlier tier is not repeated.
    """
    tiers = []
    n = len(sources)
    for i, (frame, quota) in enumerate(sources):
        # Nothing beyond rank k + quota of a source can ever be used.
        head = frame.where(F.col("rank") <= k + (quota or 0))
        tier = F.lit(i) if quota is None else F.when(F.col("rank") <= quota, i).otherwise(n + i)
        tiers.append(head.select(*by, key, "rank", tier.alias("tier")))
    pool = reduce(lambda a, b: a.unionByName(b), tiers)
    once = pool.groupBy(*by, key).agg(F.min(F.struct("tier", "rank")).alias("_best")).select(
        *by, key, F.col("_best.tier").alias("tier"), F.col("_best.rank").alias("source_rank")
    )
    order = Window.partitionBy(*by).orderBy("tier", "source_rank", key)
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidate_winner(candidates: DataFrame, by: str) -> DataFrame:
    """One proposal per question: flags in fixed order, then evidence, confidence and id."""
    flags = [
        "composition_ok", "task_ok", "product_ok", "metric_gradable", "metric_present", "metrics_complete",
        "single_point",
    ]
    order = F.struct(
        *[(-F.col(f).cast("int")).alias(f"f{i}") for i, f in enumerate(flags)],
        (-F.col("evidence_count")).alias("evidence"),
        (-F.col("confidence_rank")).alias("confidence"),
        F.col("proposal_id").alias("id"),
    )
    payload = F.struct(*candidates.columns)
    return candidates.groupBy(F.col(by).alias("_by")).agg(F.min_by(payload, order).alias("_w")).select("_w.*")


def focus_row(proposals: DataFrame, by: str, winner: str = "winner_id") -> DataFrame:
    """The recorded winner, else the first surviving proposal, else the first one."""
    order = F.struct(
        F.when(F.col("proposal_id") == F.col(winner), 0).when(F.col("status") == "surviving", 1).otherwise(2).alias("t"),
        F.col("pos").alias("p"),
    )
    payload = F.struct(*proposals.columns)
    return proposals.groupBy(F.col(by).alias("_by")).agg(F.min_by(payload, order).alias("_w")).select("_w.*")
