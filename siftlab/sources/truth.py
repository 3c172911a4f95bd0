"""Truth tables in two layouts, brought to one relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.ids import canonical_doi
from siftlab.functions.numbers import numeric_struct, truth_unit_contract, unit_suffix
from siftlab.functions.text import blank_to_null, lookup, strip, text_or_empty


def reaction_truth(samples: DataFrame) -> DataFrame:
    """Targets from samples with a nested ``meta`` (reaction_type, doc_id, metrics_gt, metals, product, units, id)."""
    meta = lambda name: F.col(f"meta.{name}")
    out = samples.select(
        F.upper(strip(text_or_empty(meta("reaction_type")))).alias("task_type"),
        canonical_doi(meta("doc_id")).alias("doi"),
        F.lit(None).cast("bigint").alias("row_number"),
        meta("metrics_gt").alias("metrics"),
        F.coalesce(meta("units"), F.create_map().cast("map<string,string>")).alias("units"),
        F.coalesce(meta("metals"), F.array().cast("array<string>")).alias("metals"),
        blank_to_null(meta("product")).alias("product"),
        meta("id").try_cast("bigint").alias("source_index"),
    )
    usable = (F.col("task_type") != "") & (F.col("doi") != "") & (F.coalesce(F.size("metrics"), F.lit(0)) > 0)
    return out.where(usable)


def property_truth(rows: DataFrame) -> DataFrame:
    """Targets from flat rows: the metric column depends on ``_schema``; rows without it are dropped."""
    task = strip(text_or_empty(F.col("_schema")))
    key = lookup(task, K.PROPERTY_METRIC_KEYS)
    columns = [c for c in sorted(set(K.PROPERTY_METRIC_KEYS.values())) if c in rows.columns]
    value = F.coalesce(*[F.when(key == c, F.col(c).cast("string")) for c in columns])
    out = rows.select(
        task.alias("task_type"),
        canonical_doi("doi").alias("doi"),
        F.col("row_number").cast("bigint").alias("row_number"),
        F.create_map(F.coalesce(key, F.lit("")), value).alias("metrics"),
        F.create_map().cast("map<string,string>").alias("units"),
        F.coalesce("metals", F.array().cast("array<string>")).alias("metals"),
        F.lit(None).cast("string").alias("product"),
        F.col("row_number").cast("bigint").alias("source_index"),
        value.alias("_value"),
        key.alias("_key"),
    )
    usable = F.col("_key").isNotNull() & (F.col("doi") != "") & (F.coalesce("_value", F.lit("")) != "")
    return out.where(usable).drop("_value", "_key")


def truth_targets(samples: DataFrame, rows: DataFrame) -> DataFrame:
    """Both layouts as one relation with context and label keys."""
    both = reaction_truth(samples).unionByName(property_truth(rows))
    keys = F.array_sort(F.map_keys("metrics"))
    label = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metrics"))))
    return both.withColumn(
        "context", F.concat_ws("|", "task_type", F.coalesce("product", F.lit("")), F.array_join(keys, ","))
    ).withColumn("label", label)


def truth_values(targets: DataFrame) -> DataFrame:
    """One row per truth value with its parse result and unit contract."""
    long = targets.select("task_type", "units", F.explode("metrics").alias("metric_key", "value"))
    declared = F.try_element_at("units", F.col("metric_key"))
    parsed = long.withColumn("_n", numeric_struct("value"))
    unit = F.coalesce(F.nullif(F.trim(declared), F.lit("")), F.nullif(unit_suffix(text_or_empty(F.col("value"))), F.lit("")), F.lit("<missing>"))
    return parsed.select(
        "task_type",
        "metric_key",
        "value",
        F.col("_n").isNotNull().alias("parsed"),
        F.coalesce("_n.comparator", F.lit("")).alias("comparator"),
        F.col("_n.value").alias("number"),
        unit.alias("unit"),
        truth_unit_contract("task_type", "metric_key", "value", declared).alias("contract"),
    )
