"""Predictions against lab feedback: pairing, errors, rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlab.functions import fixed as K, scoring as S
from siftlab.functions.text import blank_to_null
from siftlab.operators.ordinals import with_ordinal
from siftlab.session import materialize

STAGES = (
    "unknown_task", "missing_recommendation_id", "recommendation_not_found", "prediction_missing", "actual_parse_failed",
    "prediction_parse_failed", "scored",
)


def pair_predictions(
    feedback: DataFrame, recommendations: DataFrame, ranked: DataFrame, default_id: str | None = None
) -> DataFrame:
    """Each feedback row with its prediction and the first stage it fails.

    ``feedback`` has task_type, recommendation_id (may be blank), actual; ``recommendations``
    recommendation_id, components; ``ranked`` recommendation_id, task_type, pos, predicted. Of
    several ranked items for a task the last one counts.
    """
    stated = blank_to_null(F.col("recommendation_id"))
    rec = F.coalesce(stated, F.lit(default_id)) if default_id else stated
    known = recommendations.select(
        F.col("recommendation_id").alias("_rec"), F.col("components"), F.lit(True).alias("_known")
    ).dropDuplicates(["_rec"])
    items = ranked.groupBy(F.col("recommendation_id").alias("_rec"), "task_type").agg(
        F.max_by("predicted", "pos").alias("predicted"), F.lit(True).alias("_ranked")
    )
    joined = feedback.withColumn("_rec", rec).join(known, "_rec", "left").join(items, ["_rec", "task_type"], "left")
    stage = (
        F.when(~F.coalesce(F.col("task_type").isin(*K.TASKS), F.lit(False)), STAGES[0])
        .when(F.col("_rec").isNull(), STAGES[1])
        .when(F.col("_known").isNull(), STAGES[2])
        .when(F.col("_ranked").isNull(), STAGES[3])
        .when(F.col("actual").isNull(), STAGES[4])
        .when(F.col("predicted").isNull(), STAGES[5])
        .otherwise(STAGES[6])
    )
    return joined.withColumn("stage", stage).withColumn("recommendation_id", F.col("_rec")).drop("_rec", "_known", "_ranked")


def scored_pairs(
    feedback: DataFrame, recommendations: DataFrame, ranked: DataFrame, default_id: str | None = None
) -> DataFrame:
    """The rows of ``pair_predictions`` that reach the last stage, without the others in the shuffle.

    Rows that fail by their own values stay where they are. The last predictions of a recommendation
    are one map by known task, so feedback and ranked items are dealt once, by recommendation, and
    lie as later joins on it need them.
    """
    known = recommendations.select(F.col("recommendation_id").alias("_rec"), F.col("components")).dropDuplicates(["_rec"])
    kept = ranked.where(F.col("task_type").isin(*K.TASKS)).select(F.col("recommendation_id").alias("_rec"), "task_type", "pos", "predicted")
    items = kept.repartition("_rec").groupBy("_rec", "task_type").agg(F.max_by("predicted", "pos").alias("predicted"))
    by_task = items.where("predicted is not null").groupBy("_rec").agg(
        F.map_from_entries(F.collect_list(F.struct("task_type", "predicted"))).alias("_by_task")
    )
    usable = _usable(feedback, default_id)
    joined = usable.join(known.join(by_task, "_rec"), "_rec").withColumn("predicted", F.try_element_at("_by_task", F.col("task_type")))
    paired = joined.where("predicted is not null").withColumn("stage", F.lit(STAGES[-1]))
    return paired.withColumn("recommendation_id", F.col("_rec")).drop("_rec", "_by_task")


def _usable(feedback: DataFrame, default_id: str | None = None) -> DataFrame:
    """The feedback rows that do not fail by their own values."""
    stated = blank_to_null(F.col("recommendation_id"))
    rec = F.coalesce(stated, F.lit(default_id)) if default_id else stated
    return feedback.withColumn("_rec", rec).where(
        F.col("task_type").isin(*K.TASKS) & F.col("_rec").isNotNull() & F.col("actual").isNotNull()
    )


# Feedback rows that are paired ahead of the others at most.
HEAD_ROWS = 100_000


def first_scored_pairs(
    feedback: DataFrame, recommendations: DataFrame, ranked: DataFrame, order_by: list, limit_records: int, default_id: str | None = None
) -> DataFrame:
    """Rows of ``scored_pairs`` with the first ``limit_records`` in the order of feedback columns among them.

    Pairing drops feedback rows and adds none, so the first usable ones are paired alone, with the
    recommendations they name, and more of them while too few have a prediction. Where the first
    ``HEAD_ROWS`` do not suffice, all rows are paired.
    """
    if limit_records < 1:
        raise ValueError("limit_records must be at least 1")
    size = 2 * limit_records
    while size <= HEAD_ROWS:
        head = materialize(_usable(feedback, default_id).orderBy(*order_by).limit(size), "head")
        named = F.broadcast(head.select(F.col("_rec").alias("recommendation_id")).distinct())
        few = [frame.join(named, "recommendation_id", "left_semi") for frame in (recommendations, ranked)]
        found = materialize(scored_pairs(head.drop("_rec"), *few, default_id), "found")
        if found.count() >= limit_records or head.count() < size:
            return found
        size *= 8
    return scored_pairs(feedback, recommendations, ranked, default_id)


def stage_counts(paired: DataFrame) -> DataFrame:
    """Rows in total and per stage, as one row."""
    return paired.agg(
        F.count(F.lit(1)).alias("rows_total"), *[F.count_if(F.col("stage") == s).alias(f"rows_{s}") for s in STAGES]
    )


def with_errors(paired: DataFrame, unit: str | Column = "unit", profile: str = "analytics") -> DataFrame:
    """Absolute and relative error and score of the scored rows."""
    rows = paired.where("stage = 'scored'")
    rel = S.relative_error("predicted", "actual", unit, profile)
    return (
        rows.withColumn("abs_error", F.abs(F.col("predicted") - F.col("actual")))
        .withColumn("rel_error", rel)
        .withColumn("score", S.decay_score("rel_error"))
    )


def combine_metrics(records: DataFrame, keys: list[str], position: str, task: str = "CO2RR") -> DataFrame:
    """Replace the two metrics of a row by one weighted record when each occurs exactly once.

    Other rows stay as they are. The combined record takes the first position of its rows.
    """
    w = K.COMBINED_WEIGHTS
    mine = records.where(F.col("task_type") == task)

    def once(metric: str) -> Column:
        return F.count_if(F.col("metric_key") == metric) == 1

    first, second = list(w)
    value = lambda m: F.max(F.when(F.col("metric_key") == m, F.col("rel_error")))
    rel = (value(first) * w[first] + value(second) * w[second]) / (w[first] + w[second])
    groups = mine.groupBy(*keys).agg(
        (once(first) & once(second) & (F.count(F.lit(1)) == 2)).alias("_combine"),
        rel.alias("_rel"),
        F.min(position).alias("_pos"),
    )
    combined = groups.where("_combine").select(
        *keys,
        F.lit(task).alias("task_type"),
        F.lit(K.COMBINED_METRIC).alias("metric_key"),
        F.col("_pos").alias(position),
        F.col("_rel").alias("rel_error"),
        F.exp(-F.col("_rel")).alias("score"),
    )
    rest = mine.join(groups.where("_combine").select(*keys), keys, "left_anti")
    columns = [*keys, "task_type", "metric_key", position, "rel_error", "score"]
    others = records.where(F.col("task_type") != task)
    return others.select(*columns).unionByName(rest.select(*columns)).unionByName(combined.select(*columns))


def eligible_rounds(jobs: DataFrame, limit_rounds: int = 50) -> DataFrame:
    """The newest completed CSV updates that are not deleted, oldest first, numbered from 1."""
    if limit_rounds < 1:
        raise ValueError("limit_rounds must be at least 1")
    fit = jobs.where(
        (F.col("job_type") == "experience_update")
        & F.col("deleted_at").isNull()
        & (F.col("status") == "completed")
        & (F.lower("upload_format") == "csv")
    )
    newest = fit.orderBy(F.col("finished_at").desc(), F.col("job_id").desc()).limit(limit_rounds)
    return with_ordinal(newest, ["finished_at", "job_id"], "round_index").withColumn(
        "round_index", F.col("round_index") + 1
    )


def apply_ignore_list(records: DataFrame, ignored: DataFrame, keys: list[str]) -> DataFrame:
    """All records with an ``ignored`` flag; ignored rows stay listed but leave the means."""
    marks = ignored.select(*keys).distinct().withColumn("_ig", F.lit(True))
    return records.join(marks, keys, "left").withColumn("ignored", F.coalesce("_ig", F.lit(False))).drop("_ig")


def update_ignore_list(current: DataFrame, add: DataFrame, remove: DataFrame, keys: list[str]) -> DataFrame:
    """(current + add) - remove; row numbers below 1 are dropped."""
    merged = current.select(*keys).unionByName(add.select(*keys)).distinct()
    return merged.join(remove.select(*keys).distinct(), keys, "left_anti").where(F.col(keys[-1]) >= 1)


def round_means(records: DataFrame, by: str = "round_index") -> DataFrame:
    """Per round: records, total, ignored, mean score and error, and one display of the components."""
    used = ~F.col("ignored")
    n_components = F.count_distinct("components")
    return records.groupBy(by).agg(
        F.count_if(used).alias("num_records"),
        F.count(F.lit(1)).alias("num_records_total"),
        F.count_if(F.col("ignored")).alias("num_records_ignored"),
        F.avg(F.when(used, F.col("score"))).alias("mean_score"),
        F.avg(F.when(used, F.col("rel_error"))).alias("mean_rel_error"),
        F.when(n_components == 1, F.max("components"))
        .otherwise(F.concat(F.lit("mixed("), n_components.cast("string"), F.lit(")")))
        .alias("components"),
    )


def overall_means(records: DataFrame) -> DataFrame:
    used = ~F.col("ignored")
    return records.agg(
        F.count_distinct("round_index").alias("total_rounds"),
        F.count_if(used).alias("total_records"),
        F.count_if(F.col("ignored")).alias("total_records_ignored"),
        F.avg(F.when(used, F.col("score"))).alias("mean_score"),
        F.avg(F.when(used, F.col("rel_error"))).alias("mean_rel_error"),
    )


def cap_records(records: DataFrame, order_by: list, limit_records: int = 1000) -> DataFrame:
    """The first ``limit_records`` records in round order (a page of a report)."""
    if limit_records < 1:
        raise ValueError("limit_records must be at least 1")
    return records.orderBy(*order_by).limit(limit_records)


def latest_traces(traces: DataFrame, keys: list[str], newest: str, tie: str) -> DataFrame:
    """Newest trace per key."""
    order = F.struct(-F.col(newest), F.col(tie))
    return traces.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in traces.columns if c not in keys]), order).alias("_t")).select(
        *keys, "_t.*"
    )


def feedback_examples(records: DataFrame, traces: DataFrame, keys: list[str]) -> DataFrame:
    """Scored records with the trace of their recommendation and task; ``has_trace`` counts misses."""
    return records.join(traces.withColumn("_hit", F.lit(True)), keys, "left").withColumn(
        "has_trace", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def job_durations(jobs: DataFrame) -> DataFrame:
    """Seconds between start and finish, never negative, three decimals; stored values win."""
    span = F.unix_millis(F.to_timestamp("finished_at")) - F.unix_millis(F.to_timestamp("started_at"))
    return jobs.withColumn("duration_seconds", F.coalesce("duration_seconds", F.greatest(span, F.lit(0)) / 1000.0))
