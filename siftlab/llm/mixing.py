"""Mixing of sources to target weights along a time-varying curriculum, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlab.operators.ordinals import with_ordinal
from siftlab.session import materialize

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
# Weight of a source over training time as knots (time, weight); one schedule per weight, cycled.
# Only the shape matters: the area is scaled to the source's target.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)

WORD = r"[^\x20\x09-\x0D]+"
_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, rank, weight, target) from (source, source_size, n_docs).

    Sources get weights in code point order, null last. A target stops at ``max_epochs`` times
    the source's size; what is over is shared again by weight among the others until none is
    above. Each turn needs two sums over the source table; only those sums reach the driver.
    """
    ranked = with_ordinal(sizes, F.col("source").asc_nulls_last(), "rank")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = materialize(
        ranked.withColumn("weight", F.element_at(cycle, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("long")),
        "sources",
    )
    cap = F.col("source_size") * F.lit(max_epochs)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, n_capped = 0.0, -1
    while True:
        over = F.lit(False) if n_capped < 0 else F.lit(level) * F.col("weight") > cap
        row = ranked.agg(
            F.sum(F.when(over, cap).otherwise(0)).alias("held"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(over.cast("long")).alias("n"),
        ).first()
        if row["n"] is None or row["n"] == n_capped or not row["open"]:
            break
        n_capped = row["n"]
        level = (total - row["held"]) / row["open"]
    share = F.lit(float(level)) * F.col("weight")
    return ranked.withColumn("target", F.when(share > cap, cap.cast("double")).otherwise(share))


def time_of(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """Training time in [0, 1] at which a source has given ``share`` of its words.

    The weight between two knots is linear, so its integral is a parabola that is solved for the
    time; the cumulative area picks the segment.
    """
    picked = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
        whole = sum(areas)
        at = F.lit(float(knots[-1][0]))
        done = whole
        for i in reversed(range(len(areas))):
            (t0, w0), (t1, w1) = knots[i], knots[i + 1]
            done -= areas[i]
            slope = (w1 - w0) / (t1 - t0)
            rest = F.greatest(share * F.lit(float(whole)) - F.lit(float(done)), F.lit(0.0))
            root = F.lit(float(w0)) + F.sqrt(F.greatest(F.lit(float(w0 * w0)) + rest * F.lit(2.0 * slope), F.lit(0.0)))
            inside = F.lit(float(t0)) + F.when(root > 0, rest * 2.0 / root).otherwise(F.lit(0.0))
            limit = float((done + areas[i]) / whole)
            at = F.when(share <= F.lit(limit), F.least(inside, F.lit(float(t1)))).otherwise(at)
        picked = F.when(F.pmod(rank, F.lit(len(schedules))) == k, at).otherwise(picked)
    return picked


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES, seed: str = "mix",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken, position.

    Every source is one stream in the order of ``sha256(seed|id)``, repeated ``max_epochs`` times.
    A copy is taken when its middle lies before the source's target, so the words taken differ
    from the target by less than one document. ``position`` is the training time of the first
    copy (null: not taken): cumulative demand inverted through the source's schedule. Running sums are formed over
    two levels of digest digits, so a source that holds most rows is never sorted in one task.
    Reruns agree. A null text has size 0 and is taken in no copy; a null id or source is a value
    like others (null sources are one source, ranked last); repeated rows are separate documents;
    an empty table gives no rows; other columns are ignored.
    """
    narrow = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    ).withColumn("_key", F.sha2(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    narrow = materialize(
        narrow.withColumn("_b1", F.substring("_key", 1, _DIGITS)).withColumn("_b2", F.substring("_key", 1 + _DIGITS, _DIGITS)),
        "sizes",
    )
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(sizes, weights, max_epochs).select(
        F.col("source").alias("_source"), "source_size", "rank", "target"
    )
    upto = (Window.unboundedPreceding, -1)
    fine = narrow.groupBy("source", "_b1", "_b2").agg(F.sum("size").alias("_s"))
    coarse = fine.groupBy("source", "_b1").agg(F.sum("_s").alias("_s"))
    coarse_at = F.sum("_s").over(Window.partitionBy("source").orderBy("_b1").rowsBetween(*upto))
    coarse = coarse.select(F.col("source").alias("_cs"), F.col("_b1").alias("_c1"), F.coalesce(coarse_at, F.lit(0)).alias("_at1"))
    fine_at = F.sum("_s").over(Window.partitionBy("source", "_b1").orderBy("_b2").rowsBetween(*upto))
    fine = fine.select("source", "_b1", "_b2", F.coalesce(fine_at, F.lit(0)).alias("_at2"))
    fine = fine.join(coarse, F.col("source").eqNullSafe(F.col("_cs")) & (F.col("_b1") == F.col("_c1"))).select(
        F.col("source").alias("_fs"), F.col("_b1").alias("_f1"), F.col("_b2").alias("_f2"), (F.col("_at1") + F.col("_at2")).alias("_at")
    )
    inside = Window.partitionBy("source", "_b1", "_b2").orderBy("_key", "id", "size").rowsBetween(*upto)
    placed = narrow.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        fine,
        F.col("source").eqNullSafe(F.col("_fs")) & (F.col("_b1") == F.col("_f1")) & (F.col("_b2") == F.col("_f2")),
    )
    placed = placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    start = F.col("_at") + F.col("_in")
    copies = F.lit(0)
    for epoch in range(max_epochs):
        middle = F.lit(epoch) * F.col("source_size") + start + F.col("size") / 2
        copies = copies + (middle < F.col("target")).cast("int")
    copies = F.when(F.col("size") > 0, copies).otherwise(0)
    share = (start + F.col("size") / 2) / F.when(F.col("target") > 0, F.col("target"))
    return placed.withColumn("copies", copies).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rank", start.alias("offset"),
        F.when(F.col("copies") > 0, time_of(share, F.col("rank"), schedules)).alias("position"),
    )


def taken_copies(plan: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """One row per taken copy with its ``epoch`` and ``position``."""
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch")
    rows = plan.where("copies > 0").select("*", copy)
    share = (F.col("epoch") * F.col("source_size") + F.col("offset") + F.col("size") / 2) / F.col("target")
    return rows.withColumn("position", time_of(share, F.col("rank"), schedules))


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES, seed: str = "mix",
) -> DataFrame:
    """The documents as the mix takes them: dropped or repeated, range-sorted by training position.

    Has the columns of ``docs``. Rows of equal id, source and size get the plan of one of them;
    see ``mix_plan`` for the rest.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, weights, max_epochs, schedules, seed)
    copies = taken_copies(plan.dropDuplicates([id_col, source_col, "size"]), schedules)
    copies = copies.select(F.col(id_col).alias("_mix_id"), F.col(source_col).alias("_mix_source"), F.col("size").alias("_mix_n"), F.col("position").alias("_mix_position"))
    matched = F.col(id_col).eqNullSafe(F.col("_mix_id")) & F.col(source_col).eqNullSafe(F.col("_mix_source")) & (F.col("_mix_size") == F.col("_mix_n"))
    mixed = docs.withColumn("_mix_size", word_count(F.col(text_col))).join(copies, matched)
    return mixed.repartitionByRange("_mix_position").sortWithinPartitions("_mix_position").select([F.col(f"`{c}`") for c in docs.columns])


def training_order(plan: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """The taken copies range-sorted by training position."""
    return taken_copies(plan, schedules).repartitionByRange("position").sortWithinPartitions("position", "epoch")


def with_training_rank(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The plan range-sorted by the position of each document's first copy, numbered ``training_rank`` from 0.

    Positions count to nine places; ties and documents the mix leaves out (last) go by id, so no
    position makes a hot range.
    """
    order = [F.round("position", 9).asc_nulls_last(), F.col(id_col).asc_nulls_last(), F.col("offset"), F.col("size")]
    return with_ordinal(plan, order, "training_rank")
