"""Note tables: filters, coverage, operation merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.cards import is_chemistry_guideline, is_format_guideline, removed_for_reaction
from siftlab.functions.tasks import task_family
from siftlab.functions.text import as_col, squeeze, strip, text_or_empty
from siftlab.operators.ordinals import with_ordinal


def filter_by_task(notes: DataFrame, task: str | None = None, family: str | None = None) -> DataFrame:
    """Notes usable for a task: global ones, and those of its family unless they are another task's card.

    ``notes`` has kind, task_family, task_type. Adds task_exact.
    """
    target_family = family or (
        K.FAMILY_MATERIAL if task in K.MATERIAL_TASKS else K.FAMILY_REACTION if task in K.REACTION_TASKS else None
    )
    if not task and not target_family:
        return notes.withColumn("task_exact", F.lit(None).cast("boolean"))
    own = F.coalesce("task_family", task_family("task_type"), F.lit(""))
    is_global = own == K.FAMILY_GLOBAL
    keep = is_global | (own == target_family)
    exact = F.lit(None).cast("boolean")
    if task:
        other = F.col("task_type").isNotNull() & (F.col("task_type") != task)
        keep = is_global | ((own == target_family) & ~((F.col("kind") == "material_card") & F.coalesce(other, F.lit(False))))
        exact = F.when(~is_global & F.col("task_type").isNotNull(), F.col("task_type") == task)
    return notes.where(keep).withColumn("task_exact", exact)


def guideline_class(c) -> Column:
    """``format``, ``chemistry`` or ``method``."""
    return F.when(is_format_guideline(c), "format").when(is_chemistry_guideline(c), "chemistry").otherwise("method")


def prune_guidelines(blocks: DataFrame, text: str, reaction: str | None = None, min_length: int = 0) -> DataFrame:
    """Blocks that stay: not about format, not of the pruned reaction, not too short."""
    gone = is_format_guideline(text) | (F.length(strip(text_or_empty(as_col(text)))) < min_length)
    if reaction:
        gone = gone | removed_for_reaction(text, reaction)
    return blocks.where(~gone)


def coverage_by_task(cards: DataFrame, text: str) -> DataFrame:
    """Cards tagged with each of the 19 tasks, tasks without a card included."""
    body = text_or_empty(F.col(text))
    flags = [
        F.count_if(body.rlike(rf"(?i)(?:TASK|task_type)\s*[=:]\s*{t}(?:\b|;)")).alias(f"c{i}") for i, t in enumerate(K.TASKS)
    ]
    rows = F.array(*[F.struct(F.lit(t).alias("task_type"), F.col(f"c{i}").alias("cards")) for i, t in enumerate(K.TASKS)])
    return cards.agg(*flags).select(F.explode(rows).alias("r")).select("r.*").withColumn("missing", F.col("cards") == 0)


def store_statistics(notes: DataFrame) -> DataFrame:
    """Counts by reaction type and by family; nulls count as ``unknown``."""
    def counts(c: str) -> DataFrame:
        label = F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
        return notes.groupBy(label.alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("dimension", F.lit(c))

    return counts("reaction_type").unionByName(counts("task_family"))


def _is_card(c: Column) -> Column:
    return c.startswith("MaterialCard |") | c.startswith("CaseCard |")


def merge_operations(notes: DataFrame, operations: DataFrame) -> DataFrame:
    """Apply ADD, UPDATE and DELETE operations (with their position ``pos``) to a table (note_id, content).

    DELETE wins over UPDATE of the same id; of several updates the longest (then smallest) text
    wins; an UPDATE that would put a card over a plain note, or names no known id, becomes an ADD.
    Added texts are squeezed, taken once and left out when the table already holds them. New ids
    continue after the highest numeric one: ADDs in their order first, then turned updates.
    """
    ops = operations.select(
        F.upper(strip(text_or_empty(F.col("operation")))).alias("op"),
        F.nullif(strip(text_or_empty(F.col("note_id").cast("string"))), F.lit("")).alias("note_id"),
        squeeze(text_or_empty(F.col("content"))).alias("content"),
        "pos",
    )
    old = notes.select(F.col("note_id").cast("string").alias("note_id"), F.col("content"), squeeze("content").alias("_norm"))
    deleted = ops.where("op = 'DELETE' AND note_id IS NOT NULL").select("note_id").distinct()
    updates = ops.where("op = 'UPDATE' AND note_id IS NOT NULL AND content <> ''").join(deleted, "note_id", "left_anti")
    judged = updates.join(old.select("note_id", "_norm"), "note_id", "left")
    to_card = _is_card(F.col("content")) & ~_is_card(F.coalesce("_norm", F.lit("")))
    turned = judged.where(to_card).select("content", F.lit(1).alias("tier"), "pos")
    best = judged.where(~to_card).groupBy("note_id").agg(
        F.min("pos").alias("pos"),
        F.min_by("content", F.struct(-F.length("content"), F.col("content"))).alias("_new"),
        F.max(F.col("_norm").isNotNull().cast("int")).alias("_known"),
    )
    kept = (
        old.join(deleted, "note_id", "left_anti")
        .join(best.where("_known = 1").select("note_id", "_new"), "note_id", "left")
        .select("note_id", F.coalesce("_new", "content").alias("content"))
    )
    added = (
        ops.where("(op = 'ADD' OR (op = 'UPDATE' AND note_id IS NULL)) AND content <> ''")
        .select("content", F.lit(0).alias("tier"), "pos")
        .unionByName(turned)
        .unionByName(best.where("_known = 0").select(F.col("_new").alias("content"), F.lit(1).alias("tier"), "pos"))
        .groupBy("content")
        .agg(F.min(F.struct("tier", "pos")).alias("_first"))
    )
    # Texts the table held before or after the updates are known.
    known = old.select(F.col("_norm").alias("content")).unionByName(kept.select(squeeze("content").alias("content"))).distinct()
    fresh = with_ordinal(added.join(known, "content", "left_anti"), ["_first", "content"], "_k")
    start = F.coalesce(notes.agg(F.max(F.col("note_id").try_cast("bigint"))).scalar(), F.lit(-1)) + 1
    new = fresh.select((start + F.col("_k")).cast("string").alias("note_id"), "content")
    return kept.unionByName(new)
