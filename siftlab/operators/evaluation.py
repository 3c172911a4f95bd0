"""Reward, accuracy and run reports over judged rollouts.

A rollout has dataset_index (the question), task_type, reward, reasoning, exp_id, stage and,
where used, level, correct, judged_response, confidence, tool_calls, time_cost, id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.text import contains_any, text_or_empty
from siftlab.operators.keys import null_safe_join
from siftlab.operators.ordinals import top_per_group


def judged(runs: DataFrame) -> DataFrame:
    return runs.where((F.col("stage") == "judged") & F.col("reward").isNotNull())


def is_output_failure(c="reasoning") -> Column:
    return contains_any(F.lower(text_or_empty(c)), K.OUTPUT_FAILURE_MARKERS)


def task_frame(df: DataFrame) -> DataFrame:
    """The 19 task keys, one row each."""
    spark = df.sparkSession
    return spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in K.TASKS])).alias("task_type"))


def reward_by_task(runs: DataFrame) -> DataFrame:
    """One row per known task, also when it has no rollout."""
    per_task = judged(runs).groupBy("task_type").agg(
        F.count(F.lit(1)).alias("n_rollouts"),
        F.avg("reward").alias("avg_reward"),
        F.count_if(is_output_failure()).alias("output_failures"),
        F.sum("tool_calls").alias("tool_calls"),
        F.sum("time_cost").alias("time_cost"),
    )
    # At most one row per task on the right; the task list has a fixed size.
    return (
        F.broadcast(task_frame(runs))
        .join(per_task, "task_type", "left")
        .withColumn("normalized_error", 1 - F.col("avg_reward"))
        .fillna(0, ["n_rollouts", "output_failures", "tool_calls"])
    )


def reward_summary(runs: DataFrame) -> DataFrame:
    """Overall mean, macro mean over tasks, worst task, failure rate and cost, as one row."""
    per_task = judged(runs).groupBy("task_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("reward").alias("total"),
        F.count_if(is_output_failure()).alias("failures"),
        F.sum("tool_calls").alias("tool_calls"),
        F.sum("time_cost").alias("time_cost"),
    )
    known = F.col("task_type").isin(*K.TASKS)
    mean = F.when(known, F.col("total") / F.col("n"))
    return per_task.agg(
        F.sum("n").alias("n_judged"),
        (F.sum("total") / F.sum("n")).alias("avg_reward"),
        F.avg(mean).alias("macro_task_reward"),
        F.min(mean).alias("min_task_reward"),
        F.count_if(known).alias("tasks_present"),
        F.sum("failures").alias("output_failures"),
        (F.sum("failures") / F.sum("n")).alias("output_failure_rate"),
        F.sum("tool_calls").alias("tool_calls"),
        F.sum("time_cost").alias("time_cost"),
    ).withColumn("normalized_error", 1 - F.col("avg_reward"))


def group_states(runs: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row per question: all_correct, all_wrong or partial_reward."""
    far_from_one = F.max(F.abs(F.col("reward") - 1.0))
    far_from_zero = F.max(F.abs("reward"))
    grouped = judged(runs).groupBy("dataset_index").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("task_type").alias("task_type"),
        far_from_one.alias("_one"),
        far_from_zero.alias("_zero"),
        F.avg("reward").alias("mean_reward"),
        F.max("reward").alias("max_reward"),
    )
    state = (
        F.when(F.col("_one") <= tolerance, "all_correct")
        .when(F.col("_zero") <= tolerance, "all_wrong")
        .otherwise("partial_reward")
    )
    return grouped.withColumn("state", state).drop("_one", "_zero")


def group_outcomes(runs: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """State counts, partial rate and the number of model calls an update would need."""
    partial = F.col("state") == "partial_reward"
    return group_states(runs, tolerance).agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.count_if(F.col("state") == "all_correct").alias("all_correct"),
        F.count_if(F.col("state") == "all_wrong").alias("all_wrong"),
        F.count_if(partial).alias("partial_reward"),
        (F.count_if(partial) / F.count(F.lit(1))).alias("partial_group_rate"),
        (F.coalesce(F.sum(F.when(partial, F.col("n"))), F.lit(0)) + 2 * F.count_if(partial)).alias("estimated_update_calls"),
    )


def experiment_summary(runs: DataFrame) -> DataFrame:
    """Reward spread and pass rates per experiment."""
    stated = F.coalesce("reasoning", F.lit("")) != ""
    return runs.where("stage = 'judged'").groupBy("exp_id").agg(
        F.count(F.lit(1)).alias("n_judged"),
        F.avg("reward").alias("avg_reward"),
        F.min("reward").alias("min_reward"),
        F.max("reward").alias("max_reward"),
        F.count_if(F.col("reward") > 0).alias("n_gt0"),
        F.count_if(F.col("reward") >= 0.5).alias("n_ge_05"),
        F.count_if(F.col("reward") >= 0.8).alias("n_ge_08"),
        F.count_if(stated).alias("n_parse_error"),
        (F.count_if(stated) / F.count(F.lit(1))).alias("parse_error_rate"),
        (F.count_if(F.col("reward") > 0) / F.count(F.lit(1))).alias("pass_rate"),
    )


def mean_and_pass(runs: DataFrame) -> DataFrame:
    """Mean of all rewards, mean of the best per question, K = size of the largest group."""
    per_question = judged(runs).groupBy("dataset_index").agg(
        F.count(F.lit(1)).alias("n"), F.sum("reward").alias("total"), F.max("reward").alias("best"), F.sum("tool_calls").alias("calls")
    )
    return per_question.agg(
        F.max("n").alias("k"),
        (F.sum("total") / F.sum("n")).alias("mean_at_k"),
        F.avg("best").alias("pass_at_k"),
        (F.sum("calls") / F.sum("n")).alias("avg_tool_call"),
    )


def pass_at_k(runs: DataFrame, k: int, by_level: bool = False) -> DataFrame:
    """Share of questions solved within the first ``k`` valid attempts, in id order."""
    keys = (["level"] if by_level else []) + ["dataset_index"]
    valid = runs.where("judged_response <> 'invalid'")
    early = top_per_group(valid.select(*keys, "id", "correct"), keys, "id", k)
    solved_early = early.groupBy(*keys).agg(F.max(F.col("correct").cast("int")).alias("early"))
    whole = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"), F.max(F.col("correct").cast("int")).alias("solved")
    )
    report = null_safe_join(whole, solved_early, keys).groupBy(*keys[:-1])
    return report.agg(
        F.bround(F.sum("early") / F.count(F.lit(1)) * 100, 2).alias("pass_at_k"),
        F.count(F.lit(1)).alias("total_problems"),
        F.sum("solved").alias("solved_problems"),
        (F.count(F.lit(1)) - F.sum("solved")).alias("unsolved_problems"),
        F.sum("attempts").alias("total_attempts"),
    )


def accuracy(runs: DataFrame) -> DataFrame:
    """Accuracy per level over valid answers, and overall (level null) over all rows."""
    invalid = F.col("judged_response") == "invalid"
    right = F.col("correct") & ~invalid
    counts = runs.rollup("level").agg(
        F.count_if(F.col("correct")).alias("correct_all"),
        F.count_if(right).alias("correct"),
        F.count_if(~F.col("correct") & ~invalid).alias("wrong"),
        F.count_if(invalid).alias("unknown"),
        F.count(F.lit(1)).alias("total"),
        F.grouping("level").alias("is_total"),
    )
    per_level = F.coalesce(F.try_divide(F.col("correct"), F.col("correct") + F.col("wrong")), F.lit(0.0)) * 100
    overall = F.col("correct_all") / F.col("total") * 100
    total = F.col("is_total") == 1
    return counts.select(
        F.when(total, "ALL").otherwise(F.col("level").cast("string")).alias("level"),
        F.when(total, F.col("correct_all")).otherwise(F.col("correct")).alias("correct"),
        F.when(total, F.col("total") - F.col("correct_all") - F.col("unknown")).otherwise(F.col("wrong")).alias("wrong"),
        "unknown",
        "total",
        F.when(total, F.bround(overall, 2)).otherwise(F.bround(per_level, 4)).alias("accuracy"),
    )


def calibration_error(runs: DataFrame) -> DataFrame:
    """Sum over five confidence bins of n / total * |accuracy - confidence / 100|, in percent."""
    bin_of = F.least(F.floor(F.col("confidence") / 20), F.lit(4))
    valid = F.col("judged_response") != "invalid"
    bins = runs.groupBy(F.when(valid, bin_of).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("correct")).alias("right"),
        F.sum("confidence").alias("conf"),
    )
    gap = F.abs(F.col("right") / F.col("n") - F.col("conf") / F.col("n") / 100)
    return bins.agg(
        F.sum("n").alias("total"),
        (F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * gap)) / F.sum("n") * 100).alias("calibration_error"),
    )


def learnable_rows(runs: DataFrame) -> DataFrame:
    """Rollouts of questions whose mean reward lies strictly between 0 and 1."""
    mixed = (
        judged(runs).groupBy("dataset_index").agg(F.avg("reward").alias("_m")).where("_m > 0 AND _m < 1").drop("_m")
    )
    return judged(runs).join(mixed, "dataset_index", "left_semi")


def tool_usage(messages: DataFrame) -> DataFrame:
    """Totals over trajectories from one row per message: trajectory_id, role, tools (names called)."""
    return messages.groupBy("trajectory_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.sum(F.size("tools")).alias("calls"),
    ).agg(
        F.count(F.lit(1)).alias("trajectories"),
        F.sum("turns").alias("turns"),
        F.sum("assistant_turns").alias("assistant_turns"),
        F.sum("calls").alias("tool_calls"),
        (F.sum("calls") / F.count(F.lit(1))).alias("calls_per_trajectory"),
        F.try_divide(F.sum("calls"), F.sum("assistant_turns")).alias("calls_per_assistant_turn"),
    )


def tool_shares(messages: DataFrame) -> DataFrame:
    """Calls per tool and their share of all calls."""
    counts = messages.select(F.explode("tools").alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("calls"))
    total = counts.agg(F.sum("calls")).scalar()
    return counts.select("tool", "calls", (F.col("calls") / total).alias("share"))


def messages_of(trajectories: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """One row per message of JSON trajectories ``[{"trajectory": [{role, content, tool_calls}]}]``."""
    schema = (
        "array<struct<trajectory:array<struct<role:string,content:string,"
        "tool_calls:array<struct<function:struct<name:string>>>>>>>"
    )
    first = F.try_element_at(F.from_json(json_col, schema), F.lit(1))
    exploded = trajectories.select(F.col(id_col).alias("trajectory_id"), F.posexplode(first["trajectory"]).alias("turn", "m"))
    names = F.transform(F.coalesce("m.tool_calls", F.array()), lambda c: c["function"]["name"])
    return exploded.select("trajectory_id", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content"), names.alias("tools"))


def compliance_stage(
    truth_ok: Column, answer_ok: Column, is_product: Column, product_keys: Column, product_value: Column,
    extra: Column, missing: Column, numeric: Column, repaired: Column,
) -> Column:
    """First check a response fails, or how it passes."""
    return (
        F.when(~truth_ok, "gt_parse_failed")
        .when(~answer_ok, "pred_answer_missing")
        .when(is_product & ~product_keys, "product_keys_bad")
        .when(is_product & ~product_value, "product_value_bad")
        .when(is_product, "product_structured_ok")
        .when(extra, "extra_keys")
        .when(missing, "missing_keys")
        .when(numeric, "strict_numbers_only_ok")
        .when(repaired, "repaired_numbers_ok")
        .otherwise("non_numeric_unrepaired")
    )


def funnel(df: DataFrame, by: str, stage: str) -> DataFrame:
    """Rows per stage, per group and over all groups (``ALL``)."""
    counts = df.groupBy(by, stage).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(stage).agg(F.sum("n").alias("n")).withColumn(by, F.lit("ALL"))
    return counts.unionByName(total)


def run_audit(
    runs: DataFrame, expected: DataFrame, *, dataset: str, group_size: int, per_task: int, rows: int
) -> DataFrame:
    """One row with every check's count and the list of failures.

    ``runs`` has sample_id, dataset, task_type, reward, parsed, trajectory_ok; ``expected`` has
    sample_id.
    """
    bad_reward = F.col("reward").isNull() | ~F.col("reward").between(0.0, 1.0)
    samples = runs.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("task_type").alias("task_type"),
        F.count_if(F.col("dataset") != dataset).alias("foreign"),
        F.count_if(~F.col("parsed")).alias("unparsed"),
        F.count_if(~F.col("trajectory_ok")).alias("no_trajectory"),
        F.count_if(bad_reward).alias("bad_reward"),
    )
    ids = samples.select("sample_id", F.lit(1).alias("r"), F.lit(0).alias("e")).unionByName(
        expected.select("sample_id", F.lit(0).alias("r"), F.lit(1).alias("e"))
    ).groupBy("sample_id").agg(F.max("r").alias("r"), F.max("e").alias("e")).agg(
        F.count_if((F.col("r") == 0) | (F.col("e") == 0)).alias("id_mismatches")
    )
    tasks = samples.groupBy("task_type").agg(
        F.count(F.lit(1)).alias("questions"),
        F.sum("n").alias("rollouts"),
        F.sum("foreign").alias("foreign"),
        F.sum("unparsed").alias("unparsed"),
        F.sum("no_trajectory").alias("no_trajectory"),
        F.sum("bad_reward").alias("bad_reward"),
        F.count_if(F.col("n") != group_size).alias("wrong_groups"),
    )
    off = (F.col("questions") != per_task) | (F.col("rollouts") != per_task * group_size)
    totals = tasks.agg(
        F.sum("rollouts").alias("rollouts"),
        F.sum("foreign").alias("foreign"),
        F.sum("unparsed").alias("unparsed"),
        F.sum("no_trajectory").alias("no_trajectory"),
        F.sum("bad_reward").alias("bad_reward"),
        F.sum("wrong_groups").alias("wrong_groups"),
        F.count_if(off).alias("wrong_tasks"),
        F.count(F.lit(1)).alias("tasks"),
    ).withColumn("id_mismatches", ids.scalar())
    failures = F.array_compact(
        F.array(
            F.when(F.col("rollouts") != rows, "row_count"),
            F.when(F.col("foreign") > 0, "foreign_dataset"),
            F.when(F.col("id_mismatches") > 0, "sample_ids"),
            F.when(F.col("wrong_groups") > 0, "group_size"),
            F.when(F.col("unparsed") > 0, "unparsed_answers"),
            F.when(F.col("no_trajectory") > 0, "trajectories"),
            F.when(F.col("bad_reward") > 0, "rewards"),
            F.when((F.col("wrong_tasks") > 0) | (F.col("tasks") != len(K.TASKS)), "task_counts"),
        )
    )
    return totals.withColumn("failures", F.array_join(failures, ",")).withColumn(
        "status", F.when(F.col("failures") == "", "pass").otherwise("fail")
    )
