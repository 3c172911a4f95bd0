"""Task and reaction spellings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.text import as_col, fold_dashes, let, lookup, squeeze, strip, text_or_empty


def alias_key(c) -> Column:
    """Lower-case spelling with underscores as blanks and one kind of dash."""
    text = F.replace(text_or_empty(c), F.lit("_"), F.lit(" "))
    return F.lower(squeeze(F.regexp_replace(text, r"[\x{2010}-\x{2015}]+", "-")))


def canonical_task(c) -> Column:
    """One of the 19 task keys, or null."""

    def pick(raw: Column, upper: Column, key: Column) -> Column:
        underscored = F.translate(key, "- ", "__")
        return (
            F.when(upper.isin(*K.REACTION_TASKS), upper)
            .when(raw.isin(*K.MATERIAL_TASKS), raw)
            .otherwise(
                F.coalesce(lookup(key, K.TASK_ALIASES), F.when(underscored.isin(*K.MATERIAL_TASKS), underscored))
            )
        )

    raw = strip(text_or_empty(c))
    return let(pick, raw, F.replace(F.upper(raw), F.lit("-"), F.lit("")), alias_key(raw))


def canonical_reaction(c) -> Column:
    """Reaction key of experimental tables: any case, separators and local-language names."""

    def pick(raw: Column, compact: Column) -> Column:
        spoken = F.lower(squeeze(F.replace(raw, F.lit("_"), F.lit(" "))))
        return F.when(compact.isin(*K.REACTION_TASKS), compact).otherwise(
            F.coalesce(
                lookup(spoken, K.REACTION_ALIASES),
                lookup(F.replace(F.lower(raw), F.lit(" "), F.lit("")), K.REACTION_ALIASES),
            )
        )

    raw = strip(fold_dashes(text_or_empty(c)))
    return let(pick, raw, F.upper(F.regexp_replace(raw, "[^A-Za-z0-9]+", "")))


def index_task(c) -> Column:
    """Task key of index metadata, or null."""
    return let(
        lambda key: F.when(F.upper(key).isin(*K.REACTION_TASKS), F.upper(key))
        .when(key.isin(*K.MATERIAL_TASKS), key)
        .otherwise(lookup(key, K.INDEX_TASK_ALIASES)),
        F.lower(strip(text_or_empty(c))),
    )


def task_family(c) -> Column:
    task = as_col(c)
    return F.when(task.isin(*K.MATERIAL_TASKS), K.FAMILY_MATERIAL).when(
        task.isin(*K.REACTION_TASKS), K.FAMILY_REACTION
    )


def metric_of_task(c) -> Column:
    return lookup(c, {task: metric for task, (metric, _) in K.TASK_METRICS.items()})


def unit_of_task(c) -> Column:
    return lookup(c, {task: unit for task, (_, unit) in K.TASK_METRICS.items()})


def infer_note_task(fields: dict[str, str], blob, kind, family=None) -> Column:
    """``struct<family, task>`` of a note: explicit task, typed fields, names in the text, hints.

    ``fields`` names the columns task_type, property_type, reaction_type, application in order.
    """
    stated = F.coalesce(*[canonical_task(F.col(c)) for c in fields.values()])
    explicit_family = F.col(family) if family else F.lit(None).cast("string")
    text = text_or_empty(blob)
    return let(_infer_task, stated, explicit_family, text, F.lower(text), kind)


def _infer_task(stated: Column, explicit_family: Column, text: Column, low: Column, kind: Column) -> Column:
    material = F.coalesce(
        *[
            F.when(low.contains(t) | low.contains(t.replace("_", " ")), F.lit(t))
            for t in K.MATERIAL_TASKS
        ]
    )
    reaction = F.coalesce(
        *[F.when(text.rlike(rf"(?i)(?:^|[^A-Za-z0-9]){t}(?:$|[^A-Za-z0-9])"), F.lit(t)) for t in K.REACTION_TASKS]
    )
    fits_material = explicit_family.isNull() | (explicit_family == K.FAMILY_MATERIAL)
    fits_reaction = explicit_family.isNull() | (explicit_family == K.FAMILY_REACTION)
    stated_ok = stated.isNotNull() & (explicit_family.isNull() | (explicit_family == task_family(stated)))
    guess = (
        F.when(stated_ok, stated)
        .when(fits_material & material.isNotNull(), material)
        .when(fits_reaction & reaction.isNotNull(), reaction)
    )
    hinted = (kind == "guideline") & low.rlike("|".join(h.replace("-", "\\-") for h in K.NEUTRAL_HINTS))

    def build(task: Column) -> Column:
        inferred = F.coalesce(task_family(task), explicit_family, F.when(hinted, K.FAMILY_GLOBAL))
        return F.struct(inferred.alias("family"), task.alias("task"))

    return let(build, guess)
