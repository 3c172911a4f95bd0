"""Duplicates, label conflicts, selection and audit counts over observations.

An observation has task_type, doi, material_identity, context_key, label_key, status, ready and a
source position (source_file, row_number, extraction_index, material_index) that is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlab.operators.keys import null_safe_join
from siftlab.operators.ordinals import best_per_group

ENTITY = ["task_type", "doi", "material_identity"]
CONTEXT = [*ENTITY, "context_key"]
EXACT = [*CONTEXT, "label_key"]
POSITION = ["source_file", "row_number", "extraction_index", "material_index"]
STATUSES = ("manual_review", "recoverable", "direct")


def status_rank(c="status") -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col == "direct", 2).when(col == "recoverable", 1).when(col == "manual_review", 0).otherwise(-1)


def status_of(rank: Column) -> Column:
    return F.when(rank == 2, "direct").when(rank == 1, "recoverable").otherwise("manual_review")


def exact_groups(obs: DataFrame) -> DataFrame:
    """One row per distinct (entity, context, label): count, best status rank, any ready."""
    return obs.groupBy(*EXACT).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(status_rank()).alias("best_rank"),
        F.max(F.col("ready").cast("int")).alias("any_ready"),
    )


def context_groups(obs: DataFrame) -> DataFrame:
    """One row per context, built on the exact groups so that only distinct labels travel on."""
    return exact_groups(obs).groupBy(*CONTEXT).agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.sum("n").alias("n_rows"),
        F.count_if(F.col("n") > 1).alias("dup_groups"),
        F.sum(F.col("n") - 1).alias("dup_removed"),
        F.max("best_rank").alias("best_rank"),
        F.max("any_ready").alias("any_ready"),
    )


def duplicate_counts(obs: DataFrame) -> DataFrame:
    return exact_groups(obs).groupBy("task_type").agg(
        F.sum("n").alias("raw_observations"),
        F.count(F.lit(1)).alias("unique_samples"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.sum(F.col("n") - 1).alias("rows_removed"),
    )


def conflict_groups(obs: DataFrame) -> DataFrame:
    """Contexts with more than one label."""
    return context_groups(obs).where("n_labels > 1").select(*CONTEXT, "n_labels", "n_rows")


def conflict_rows(obs: DataFrame) -> DataFrame:
    """Every distinct label of every conflicting context, one row each (no list per group)."""
    groups = exact_groups(obs)
    bad = groups.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("n_labels")).where("n_labels > 1")
    return null_safe_join(groups, bad, CONTEXT).select(*EXACT, "n_labels", F.col("n").alias("label_rows"))


def multi_context_entities(obs: DataFrame) -> DataFrame:
    contexts = obs.select(*CONTEXT).distinct()
    return contexts.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("n_contexts")).where("n_contexts > 1")


def readiness_counts(obs: DataFrame) -> DataFrame:
    """Best status and readiness of contexts without a conflict, per task."""
    clean = F.col("n_labels") == 1
    usable = clean & (F.col("best_rank") >= 1)
    return context_groups(obs).groupBy("task_type").agg(
        F.count_if(clean).alias("nonconflicting"),
        F.count_if(clean & (F.col("best_rank") == 2)).alias("direct"),
        F.count_if(clean & (F.col("best_rank") == 1)).alias("recoverable"),
        F.count_if(clean & (F.col("best_rank") <= 0)).alias("manual_review"),
        F.count_if(usable).alias("trainable"),
        F.count_if(usable & (F.col("any_ready") == 1)).alias("ready"),
    )


def cross_record_report(obs: DataFrame) -> DataFrame:
    """All duplicate, conflict and readiness counters per task with a grand total (task ``ALL``)."""
    clean = F.col("n_labels") == 1
    usable = clean & (F.col("best_rank") >= 1)
    entities = context_groups(obs).groupBy(*ENTITY).agg(
        F.sum("n_rows").alias("raw"),
        F.sum("n_labels").alias("uniq"),
        F.sum("dup_groups").alias("dup_groups"),
        F.sum("dup_removed").alias("dup_removed"),
        F.count_if(~clean).alias("conflicts"),
        F.sum(F.when(~clean, F.col("n_rows")).otherwise(0)).alias("conflict_rows"),
        F.count(F.lit(1)).alias("contexts"),
        F.count_if(clean).alias("clean"),
        F.count_if(usable).alias("trainable"),
        F.count_if(usable & (F.col("any_ready") == 1)).alias("ready"),
    )
    return (
        entities.rollup("task_type")
        .agg(
            F.sum("raw").alias("raw_observations"),
            F.sum("uniq").alias("unique_samples"),
            F.sum("dup_groups").alias("duplicate_groups"),
            F.sum("dup_removed").alias("rows_removed"),
            F.sum("conflicts").alias("conflict_groups"),
            F.sum("conflict_rows").alias("conflict_rows"),
            F.count_if(F.col("contexts") > 1).alias("multi_context_entities"),
            F.sum("clean").alias("nonconflicting"),
            F.sum("trainable").alias("trainable"),
            F.sum("ready").alias("ready"),
        )
        .withColumn("task_type", F.coalesce("task_type", F.lit("ALL")))
    )


def position_key() -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-1")) for c in POSITION])


def best_order() -> list[Column]:
    return [
        -status_rank(),
        F.col("source_file"),
        *[F.coalesce(F.col(c), F.lit(-1)) for c in POSITION[1:]],
    ]


def best_of_group(obs: DataFrame) -> DataFrame:
    """The best observation of every exact group: status first, then source position."""
    return best_per_group(obs, EXACT, best_order())


def select_candidates(obs: DataFrame, complete: Column | None = None) -> DataFrame:
    """Every observation with its outcome.

    ``selected``, ``exact_duplicate``, ``conflicting_context`` or
    ``manual_review_or_missing_minimum_fields``. ``complete`` is the minimum-field test. Outcomes
    are joined back on the unique source position, so no join key is hot.
    """
    complete = F.lit(True) if complete is None else complete
    keyed = obs.withColumn("_pos", position_key())
    # Only what the decision needs is grouped; the rest of the row stays where it is.
    slim = keyed.select(*EXACT, *POSITION, "status", "_pos", complete.alias("_complete"))
    best = best_per_group(slim, EXACT, best_order())
    # One row per exact group already, so labels are counted without a second pass over the observations.
    labels = best.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("_n"))
    judged = null_safe_join(best, labels.where("_n > 1").select(*CONTEXT, F.lit(True).alias("_bad")), CONTEXT, "left")
    outcome = (
        F.when(F.col("_bad"), "conflicting_context")
        .when((status_rank() >= 1) & F.col("_complete"), "selected")
        .otherwise("manual_review_or_missing_minimum_fields")
    )
    marked = judged.select("_pos", outcome.alias("_outcome"))
    return (
        keyed.join(marked, "_pos", "left")
        .withColumn("outcome", F.coalesce("_outcome", F.lit("exact_duplicate")))
        .drop("_pos", "_outcome")
    )


def selection_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy("task_type", "outcome", "status").agg(F.count(F.lit(1)).alias("n"))


def candidate_counts(obs: DataFrame, complete: Column | None = None) -> DataFrame:
    """``selection_counts(select_candidates(obs, complete))`` from sums per exact group.

    The best row of a group has the group's best status, so no row is looked for, none is joined
    back, and equal rows are added up before the shuffle. With a minimum-field test or statuses
    outside ``STATUSES`` the best row itself is needed, and the rows are selected.
    """
    if complete is not None or not obs.where(status_rank() < 0).isEmpty():
        return selection_counts(select_candidates(obs, complete))
    ranks = range(len(STATUSES))
    groups = obs.groupBy(*EXACT).agg(
        *[F.count_if(status_rank() == r).alias(f"_n{r}") for r in ranks], F.max(status_rank()).alias("_best")
    )
    contexts = groups.groupBy(*CONTEXT).agg(
        (F.count(F.lit(1)) > 1).alias("_bad"),
        *[F.sum(f"_n{r}").alias(f"_n{r}") for r in ranks],
        *[F.count_if(F.col("_best") == r).alias(f"_kept{r}") for r in ranks],
    )

    def kept(r: int, bad: bool) -> Column:
        return F.sum(F.when(F.col("_bad") == bad, F.col(f"_kept{r}")).otherwise(0))

    parts = {}
    for r, status in enumerate(STATUSES):
        parts["exact_duplicate", status] = F.sum(F.col(f"_n{r}") - F.col(f"_kept{r}"))
        parts["conflicting_context", status] = kept(r, True)
        parts["selected" if r >= 1 else "manual_review_or_missing_minimum_fields", status] = kept(r, False)
    sums = contexts.groupBy("task_type").agg(*[n.alias(f"_s{i}") for i, n in enumerate(parts.values())])
    rows = [F.struct(F.lit(o).alias("outcome"), F.lit(s).alias("status"), F.col(f"_s{i}").alias("n")) for i, (o, s) in enumerate(parts)]
    return sums.select("task_type", F.inline(F.array(*rows))).where("n > 0")


def readiness_rates(obs: DataFrame) -> DataFrame:
    """Direct and direct-or-recoverable shares over all observations and the recommendation."""
    counts = obs.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("status") == "direct").alias("direct"),
        F.count_if(F.col("status") == "recoverable").alias("recoverable"),
        F.count_if(F.col("status") == "manual_review").alias("manual_review"),
    )
    both = F.col("direct") + F.col("recoverable")
    return counts.select(
        "*",
        F.coalesce(F.try_divide("direct", "candidates"), F.lit(0.0)).alias("direct_rate"),
        F.coalesce(F.try_divide(both, F.col("candidates")), F.lit(0.0)).alias("usable_rate"),
        F.when(F.col("direct") > 0, "usable_with_gating").otherwise("not_ready").alias("recommendation"),
    )


def field_coverage(df: DataFrame, fields: dict[str, Column], by: str) -> DataFrame:
    """Rows and non-empty counts of every field per group, measured for each field."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(present).alias(f"{name}_present") for name, present in fields.items()]
    )


def truth_parse_statistics(values: DataFrame) -> DataFrame:
    """Counts per (task, metric, contract) of parseable values, comparators and unit suffixes.

    Expects task_type, metric_key, value, comparator, unit, contract, parsed.
    """
    return values.groupBy("task_type", "metric_key", "contract", "unit").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(F.col("parsed")).alias("n_parseable"),
        F.count_if(F.col("parsed") & (F.col("comparator") != "")).alias("n_with_comparator"),
    )


def review_queue(obs: DataFrame, records: DataFrame) -> DataFrame:
    """Records and observations that are not direct, and conflicting contexts, in one frame."""
    key = F.concat_ws("/", *ENTITY)
    a = records.where("status <> 'direct'").select(
        F.lit("record").alias("origin"), "task_type", "doi", F.col("status"), F.col("reason")
    )
    b = obs.where("status <> 'direct'").select(
        F.lit("observation").alias("origin"), "task_type", "doi", "status", key.alias("reason")
    )
    c = conflict_groups(obs).select(
        F.lit("cross_record_conflict").alias("origin"),
        "task_type",
        "doi",
        F.lit("manual_review").alias("status"),
        F.lit("conflicting_labels_for_indistinguishable_material_context").alias("reason"),
    )
    return a.unionByName(b).unionByName(c)
