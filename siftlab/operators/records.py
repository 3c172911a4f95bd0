"""Cleaning of raw records: metrics, products, materials, labels, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.chemistry import product_label, sorted_symbols
from siftlab.functions.folding import canonical_text
from siftlab.functions.numbers import comparator_is_bound, decimal_text, leading_number, numeric_struct, unit_suffix
from siftlab.functions.tasks import canonical_reaction
from siftlab.functions.text import all_matches, as_col, blank_to_null, let, strip, text_or_empty
from siftlab.functions.units import (
    condition_status, current_density_ma, metric_key, metric_text, normalize_metric, percent_fraction,
)


def clean_records(raw: DataFrame) -> DataFrame:
    """Records with their metrics in canonical keys and units, and what was dropped and why.

    ``raw`` has id, source, reaction_type, metals (array), material_name and metrics (map of raw
    column to text). All of it happens inside the row. Adds metrics_gt, metrics_raw and units
    maps, ``dropped`` (array of metric reasons) and ``drop_reason`` (null for kept records).
    """
    allowed = F.map_from_arrays(
        F.array(*[F.lit(r) for r in K.REACTION_METRICS]),
        F.array(*[F.array(*[F.lit(m) for m in ms]) for ms in K.REACTION_METRICS.values()]),
    )
    skip = F.array(*[F.lit(k) for k in K.NON_METRIC_KEYS])
    entries = F.filter(F.map_entries("metrics"), lambda e: ~F.array_contains(skip, e["key"]))

    def judged(reaction: Column, scope: Column) -> Column:
        """Every metric with its canonical key, converted value and reject reason."""

        def checked(e: Column, key: Column, early: Column) -> Column:
            """Values are converted only for metrics that are in scope."""
            n = F.when(early.isNull(), normalize_metric(e["value"], key))
            return F.struct(e["key"].alias("raw_key"), key.alias("key"), e["value"].alias("raw"), n.alias("n"), early.alias("early"))

        def early_reason(key: Column, value: Column) -> Column:
            return (
                F.when(value.isNull(), "null_value")
                .when(key == "", "empty_key")
                .when(~F.array_contains(F.coalesce(scope, F.array(key)), key), "metric_not_in_scope")
            )

        return F.transform(
            entries,
            lambda e: let(
                lambda key: let(lambda early: checked(e, key, early), early_reason(key, e["value"])), metric_key(e["key"], reaction)
            ),
        )

    # Steps are columns of their own, not one bound expression: what a query does not ask for is not computed.
    reaction, rows, good, last = (F.col(c) for c in ("_reaction", "_rows", "_good", "_last"))
    staged = raw.withColumn("_reaction", canonical_reaction("reaction_type")).withColumn("_scope", F.try_element_at(allowed, reaction))
    staged = staged.withColumn("_rows", judged(reaction, F.col("_scope"))).withColumn("_good", F.filter(rows, lambda m: m["n"].isNotNull()))
    # A potential is preferred to an overpotential of the same record.
    twice = F.coalesce((reaction == "UOR") & F.exists(good, lambda m: m["raw_key"] == "potential"), F.lit(False))
    staged = staged.withColumn("_twice", twice)
    hidden = lambda m: F.col("_twice") & (m["raw_key"] == "overpotential")
    staged = staged.withColumn("_kept", F.filter(good, lambda m: ~hidden(m)))
    # Two raw columns may still meet in one key; the last one stands.
    later = lambda m, i: F.exists(F.slice("_kept", i + 2, F.size("_kept")), lambda o: o["key"] == m["key"])
    staged = staged.withColumn("_last", F.when(F.size("_kept") < 2, F.col("_kept")).otherwise(F.filter("_kept", lambda m, i: ~later(m, i))))
    given = F.coalesce("metals", F.array().cast("array<string>"))

    pairs = lambda items, v: F.map_from_entries(F.transform(items, lambda m: F.struct(m["key"], v(m))))
    dropped = F.concat(
        F.array_compact(F.transform(rows, lambda m: F.coalesce(m["early"], F.when(m["n"].isNull(), "unparseable_value")))),
        F.transform(F.filter(good, hidden), lambda m: F.lit("duplicate_metric_prefer_potential")),
    )
    unnamed = ~F.coalesce(F.exists(given, lambda m: strip(m) != ""), F.lit(False))
    nameless = unnamed & (strip(text_or_empty(F.col("material_name"))) == "")
    reason = (
        F.when(reaction.isNull(), "unknown_reaction_type")
        .when(nameless, "missing_material_identity")
        .when(F.size(last) == 0, "no_metrics_after_cleaning")
    )
    return staged.select(
        "id",
        "source",
        F.coalesce(reaction, F.col("reaction_type")).alias("reaction_type"),
        sorted_symbols(given).alias("metals"),
        pairs(last, lambda m: metric_text(m["n"])).alias("metrics_gt"),
        pairs(last, lambda m: m["raw"]).alias("metrics_raw"),
        pairs(F.filter(last, lambda m: m["n"]["unit"].isNotNull()), lambda m: m["n"]["unit"]).alias("units"),
        dropped.alias("dropped"),
        reason.alias("drop_reason"),
    )


def drop_accounting(cleaned: DataFrame) -> DataFrame:
    """Kept and dropped records and dropped metrics per source and reason, in one pass."""
    outcome = F.struct(F.lit("record").alias("kind"), F.coalesce("drop_reason", F.lit("kept")).alias("reason"))
    # Metrics are only looked at once a record has a known reaction and an identity.
    looked_at = F.coalesce("drop_reason", F.lit("")).isin("", "no_metrics_after_cleaning")
    metrics = F.transform(F.filter("dropped", lambda r: looked_at), lambda r: F.struct(F.lit("metric").alias("kind"), r.alias("reason")))
    rows = cleaned.select("source", F.explode(F.concat(F.array(outcome), metrics)).alias("o"))
    return rows.groupBy("source", "o.kind", "o.reason").agg(F.count(F.lit(1)).alias("n"))


def product_truth(records: DataFrame) -> DataFrame:
    """Truth product (highest efficiency, first in ties) and its partial current density.

    ``records`` has product, faradaic_efficiency (arrays of text) and current_density (array of
    struct type, product, value). A reported partial current of the product wins, else the total
    current (of the product, else any) times the efficiency.
    """
    pairs = F.transform(
        F.arrays_zip("product", "faradaic_efficiency"),
        lambda z, i: F.struct(
            percent_fraction(z["faradaic_efficiency"]).alias("fe"), (-i).alias("order"), product_label(z["product"]).alias("product")
        ),
    )
    best = F.array_max(F.filter(pairs, lambda p: p["fe"].isNotNull()))
    currents = F.filter(
        F.transform(
            "current_density",
            lambda c: F.struct(
                F.lower(strip(text_or_empty(c["type"]))).alias("type"),
                product_label(c["product"]).alias("product"),
                current_density_ma(c["value"]).alias("ma"),
            ),
        ),
        lambda c: c["ma"].isNotNull(),
    )
    staged = records.withColumn("_best", best).withColumn("_cd", currents)

    def largest(kind: str, same: bool) -> Column:
        hit = lambda c: (c["type"] == kind) & ((c["product"] == F.col("_best.product")) if same else F.lit(True))
        sized = F.transform(F.filter("_cd", hit), lambda c, i: F.struct(F.abs(c["ma"]).alias("a"), (-i).alias("o"), c["ma"].alias("ma")))
        return F.array_max(sized)["ma"]

    staged = staged.withColumn("_partial", largest("partial", True)).withColumn(
        "_total", F.coalesce(largest("total", True), largest("total", False))
    )
    # Narrower decimals, so that the product of the two stays exact.
    computed = F.col("_total").cast("decimal(18,6)") * F.col("_best.fe").cast("decimal(12,8)")
    value = F.coalesce(F.col("_partial").cast("decimal(30,12)"), computed.cast("decimal(30,12)"))
    same_size = (F.size("product") == F.size("faradaic_efficiency")) & (F.size("product") > 0)
    reason = (
        F.when(~F.coalesce(same_size, F.lit(False)), "co2rr_final_mismatched_lists")
        .when(F.coalesce("_best.product", F.lit("")) == "", "co2rr_missing_truth_product")
        .when(~F.col("_best.product").isin(*K.TRUTH_PRODUCTS), "co2rr_unwanted_truth_product")
        .when(value.isNull(), "co2rr_missing_partial_current_density")
    )
    source = F.when(F.col("_partial").isNotNull(), "reported_partial").when(value.isNotNull(), "computed_total_times_fe")
    kept = [c for c in records.columns if c not in ("product", "faradaic_efficiency", "current_density")]
    return staged.select(
        *kept,
        F.col("_best.product").alias("product"),
        decimal_text(F.col("_best.fe")).alias("faradaic_efficiency"),
        decimal_text(value).alias("partial_current_density"),
        source.alias("partial_source"),
        reason.alias("drop_reason"),
    )


def split_tasks(records: DataFrame) -> DataFrame:
    """Product records become a product task and, with a partial current, a regression task."""
    co2 = F.col("reaction_type") == "CO2RR"
    has = lambda k: F.array_contains(F.map_keys("metrics_gt"), k)
    tasks = F.array_compact(
        F.array(
            F.when(co2, F.lit("co2rr_top_product")),
            F.when(co2 & has("partial_current_density"), F.lit("co2rr_partial_current_density")),
            F.when(~co2, F.lit("metrics")),
        )
    )
    out = records.withColumn("task", F.explode(tasks))
    answer = F.when(
        F.col("task") == "co2rr_top_product",
        F.map_concat(
            F.map_filter("metrics_gt", lambda k, v: k == "faradaic_efficiency"), F.create_map(F.lit("product"), F.col("product"))
        ),
    ).when(
        F.col("task") == "co2rr_partial_current_density", F.map_filter("metrics_gt", lambda k, v: k == "partial_current_density")
    ).otherwise(F.col("metrics_gt"))
    return out.withColumn("answer", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(answer)))))


def backfill_feedback(rows: DataFrame) -> DataFrame:
    """Fill the two-metric columns of product rows from value and unit; others get blanks."""
    product = F.upper(strip(text_or_empty(F.col("reaction_type")))) == "CO2RR"
    blank = lambda c: F.coalesce(blank_to_null(F.col(c)), F.lit(None).cast("string"))
    fill = lambda c, other: F.when(product, F.coalesce(blank(c), blank(other), F.lit(""))).otherwise(F.coalesce(F.col(c), F.lit("")))
    out = rows.withColumn("partial_current_density", fill("partial_current_density", "value")).withColumn(
        "partial_current_density_unit", fill("partial_current_density_unit", "unit")
    )
    out = out.withColumn(
        "faradaic_efficiency_unit",
        F.when(product, F.coalesce(blank("faradaic_efficiency_unit"), F.lit("%"))).otherwise(
            F.coalesce("faradaic_efficiency_unit", F.lit(""))
        ),
    )
    return out.withColumn("missing_efficiency", product & blank("faradaic_efficiency").isNull())


def point_labels(task, metrics) -> Column:
    """``struct<values, deferred>`` of a metrics map (key -> struct raw, unit).

    One-sided bounds and exchange currents outside mA cm-2 are deferred with a reason; exact and
    approximate values are kept.
    """
    t = as_col(task)

    def judge(e: Column) -> Column:
        def build(n: Column, unit: Column) -> Column:
            off = (t == "HOR") & (e["key"] == "exchange_current_density") & (unit != "macm-2")
            reason = F.when(comparator_is_bound(n["comparator"]), "one_sided_bound_requires_interval_verify").when(
                off, "noncanonical_or_relative_exchange_current_density"
            )
            return F.struct(e["key"].alias("k"), n["value"].alias("v"), n["comparator"].alias("c"), reason.alias("r"))

        unit = F.translate(F.lower(text_or_empty(e["value"]["unit"])), "− ", "-")
        return let(build, numeric_struct(e["value"]["raw"]), unit)

    def split(rows: Column) -> Column:
        keep = F.filter(rows, lambda x: x["r"].isNull() & x["v"].isNotNull())
        defer = F.filter(rows, lambda x: x["r"].isNotNull())
        return F.struct(
            F.map_from_entries(F.transform(keep, lambda x: F.struct(x["k"], x["v"]))).alias("values"),
            F.map_from_entries(F.transform(defer, lambda x: F.struct(x["k"], x["r"]))).alias("deferred"),
        )

    return let(split, F.transform(F.map_entries(as_col(metrics)), judge))


def dataset_manifest(candidates: DataFrame) -> DataFrame:
    """Canonical records, point samples, values and deferrals per task with a total (``ALL``)."""
    p = candidates.withColumn("_p", point_labels("task_type", "metrics"))
    reason = lambda r: F.size(F.filter(F.map_values("_p.deferred"), lambda x: x == r))
    counts = p.rollup("task_type").agg(
        F.count(F.lit(1)).alias("canonical_records"),
        F.count_if(F.size("_p.values") > 0).alias("point_samples"),
        F.sum(F.size("metrics")).alias("metric_values"),
        F.sum(F.size("_p.values")).alias("point_values"),
        F.sum(reason("one_sided_bound_requires_interval_verify")).alias("bounded_deferred"),
        F.sum(reason("noncanonical_or_relative_exchange_current_density")).alias("semantic_deferred"),
    )
    return counts.withColumn("task_type", F.coalesce("task_type", F.lit("ALL")))


def clean_material(c) -> Column:
    """Material JSON with only the 12 known fields, blanks removed at every level of the field.

    Lists keep their non-blank items; a serial number must be a positive whole number; elements
    given as text are split. Returns key-sorted JSON, null when nothing is left.
    """
    fields = F.from_json(as_col(c), "map<string,string>")
    known = F.array(*[F.lit(f) for f in K.MATERIAL_FIELDS])

    def tidy(v: Column) -> Column:
        items = F.filter(F.transform(F.from_json(v, "array<string>"), strip), lambda x: x.isNotNull() & (x != "") & (x != "null"))
        inner = F.map_filter(
            F.transform_values(F.from_json(v, "map<string,string>"), lambda k, x: strip(x)), lambda k, x: x.isNotNull() & (x != "")
        )
        return (
            F.when(v.startswith("["), F.when(F.size(items) > 0, F.to_json(items)))
            .when(v.startswith("{"), F.when(F.size(inner) > 0, F.to_json(inner)))
            .when(v != "", v)
        )

    def field(k: Column, v: Column) -> Column:
        serial = F.when(v.rlike("^[0-9]+$") & (v.try_cast("bigint") >= 1), v)
        listed = F.filter(F.transform(F.split(v, "[,，;；、/]+"), strip), lambda x: x != "")
        elements = F.when(v.startswith("["), v).when(F.size(listed) > 0, F.to_json(listed))
        return F.when(k == "material_serial_no", serial).when(k == "elements", elements).otherwise(v)

    entries = F.filter(F.map_entries(fields), lambda e: F.array_contains(known, e["key"]))
    tidied = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), let(tidy, strip(e["value"])).alias("value")))
    kept = F.filter(tidied, lambda e: e["value"].isNotNull())
    final = F.filter(
        F.transform(kept, lambda e: F.struct(e["key"].alias("key"), field(e["key"], e["value"]).alias("value"))),
        lambda e: e["value"].isNotNull(),
    )
    return let(lambda x: F.when(F.size(x) > 0, F.to_json(F.map_from_entries(x))), F.array_sort(final))


def material_text(c) -> Column:
    """Sentences of the fields present in a cleaned material; fails without a name."""
    def build(m: Column) -> Column:
        get = lambda k: F.try_element_at(m, F.lit(k))

        def shown(k: str, sep: str = "、") -> Column:
            return let(
                lambda v: F.when(v.startswith("["), F.array_join(F.from_json(v, "array<string>"), sep)).otherwise(v), get(k)
            )

        sentence = lambda before, k, after, sep="、": F.concat(F.lit(before), shown(k, sep), F.lit(after))
        name = F.coalesce(get("material_name"), F.raise_error("material_name is required").cast("string"))
        return F.concat_ws(
            "",
            F.concat(F.lit("材料是"), name, F.lit("。")),
            sentence("材料类别是", "major_category", "。"),
            sentence("材料组分包括：", "components", "。"),
            sentence("结构关系：", "structure_relationships", "。", "；"),
            sentence("以前驱体", "precursors", "制备。"),
            sentence("前驱体投料比为：", "feed_ratio", "。", "："),
            sentence("通过", "preparation_method", "的方式制备。"),
            sentence("含有元素：", "elements", "。"),
            sentence("元素含量大概分别为：", "element_content", "。"),
        )

    return let(build, F.from_json(as_col(c), "map<string,string>"))


def context_key(task, fields: dict[str, str]) -> Column:
    """Context of an extraction as JSON: what makes two labels comparable, per task.

    ``fields`` names the columns ``evidence`` and ``temperature``.
    """
    t = as_col(task)
    evidence = canonical_text(F.col(fields["evidence"]))
    none = F.array(F.lit("unspecified"))

    def found(pattern: str) -> Column:
        return let(
            lambda a: F.when(F.size(a) > 0, a).otherwise(none), F.array_sort(F.array_distinct(all_matches(evidence, pattern)))
        )

    temperature = F.col(fields["temperature"])
    number = leading_number(text_or_empty(temperature))
    unit = F.nullif(unit_suffix(text_or_empty(temperature)), F.lit(""))
    heat = F.struct(
        F.lit("figure_of_merit").alias("metric"),
        F.coalesce(decimal_text(number), F.lit("unspecified")).alias("temperature"),
        F.coalesce(unit, F.lit("unspecified")).alias("temperature_unit"),
    )
    return (
        F.when(
            t == "photocatalytic_h2o2",
            F.to_json(F.struct(F.lit("apparent_quantum_efficiency").alias("metric"), found(K.WAVELENGTH).alias("wavelengths"))),
        )
        .when(t == "thermoelectric", F.to_json(heat))
        .when(t == "antibacterial", F.to_json(F.struct(F.lit("antibacterial").alias("metric"), found(K.ORGANISM).alias("organisms"))))
        .when(
            t == "furfural_hydrogenation",
            F.to_json(F.struct(found(K.REACTION_CONDITION).alias("conditions"), F.lit("furfuryl_alcohol_yield").alias("metric"))),
        )
        .otherwise(F.to_json(F.struct(t.alias("metric"))))
    )


def metric_grade(task, fields: dict[str, str]) -> Column:
    """``struct<grade, reason>``: direct, recoverable or unusable, per task contract.

    ``fields`` maps efficiency, yield, merit, temperature, threshold, concentration to columns.
    """
    t = as_col(task)
    col = lambda k: text_or_empty(F.col(fields[k]))
    ok = lambda k: leading_number(col(k)).isNotNull()

    def result(grade: str, reason: str = "") -> Column:
        return F.struct(F.lit(grade).alias("grade"), F.lit(reason).alias("reason"))

    def percent(k: str, missing: str, unit: str) -> Column:
        return F.when(~ok(k), result("unusable", missing)).when(~col(k).contains("%"), result("recoverable", unit)).otherwise(
            result("direct")
        )

    heat = (
        F.when(~ok("merit"), result("unusable", "unparseable_figure_of_merit"))
        .when((col("temperature") != "") & ~ok("temperature"), result("recoverable", "unparseable_optional_temperature"))
        .when(
            ok("temperature") & ~F.lower(col("temperature")).contains("k"),
            result("recoverable", "temperature_unit_not_explicit_kelvin"),
        )
        .otherwise(result("direct"))
    )
    full = F.lower(strip(col("threshold"))).isin("complete", "completely", "full")
    dose = (
        F.when(ok("threshold") & ok("concentration"), result("direct"))
        .when(full & ok("concentration"), result("recoverable", "categorical_complete_threshold_requires_policy"))
        .when(ok("threshold") | ok("concentration"), result("recoverable", "partial_antibacterial_metric_label"))
        .otherwise(result("unusable", "no_parseable_antibacterial_metric"))
    )
    return (
        F.when(
            t == "photocatalytic_h2o2",
            percent("efficiency", "unparseable_apparent_quantum_efficiency", "quantum_efficiency_unit_not_explicit_percent"),
        )
        .when(t == "furfural_hydrogenation", percent("yield", "unparseable_furfuryl_alcohol_yield", "yield_unit_not_explicit_percent"))
        .when(t == "thermoelectric", heat)
        .when(t == "antibacterial", dose)
        .otherwise(result("unusable", "unknown_task_metric_contract"))
    )


def condition_present(task, evidence, temperature) -> Column:
    """Whether the main condition of the task is stated."""
    t, text = as_col(task), F.lower(text_or_empty(evidence))
    return (
        F.when(t == "thermoelectric", leading_number(text_or_empty(temperature)).isNotNull())
        .when(t == "photocatalytic_h2o2", text.rlike(rf"{K.WAVELENGTH}|wavelength"))
        .when(t == "antibacterial", text.rlike(K.ORGANISM_PRESENT))
        .when(t == "furfural_hydrogenation", text.rlike(K.CONDITION_PRESENT))
        .otherwise(F.lit(False))
    )


def condition_gate(df: DataFrame, metric: str, condition: str, drop_mismatch: bool = True, require_ok: bool = False) -> DataFrame:
    """Adds condition_status and applies the 10 mA cm-2 rule to the metrics that need it."""
    needs = F.col(metric).contains("10mAcm-2")
    out = df.withColumn("condition_status", condition_status(F.col(condition)))
    bad = F.lit(False)
    if drop_mismatch:
        bad = bad | (F.col("condition_status") == "mismatch")
    if require_ok:
        bad = bad | (F.col("condition_status") == "unknown")
    return out.where(~(needs & bad))


def infer_metric(reaction, label) -> Column:
    """Metric key from a free label under a reaction; a blank label means the reaction's only metric."""
    r = as_col(reaction)
    only = F.coalesce(*[F.when(r == k, F.lit(v[0])) for k, v in K.REACTION_METRICS.items() if len(v) == 1])
    folded = F.translate(F.replace(F.replace(text_or_empty(label), F.lit("η"), F.lit("eta")), F.lit("Η"), F.lit("eta")), "−–‑—", "----")

    def pick(key: Column) -> Column:
        return (
            F.when(key == "", F.when(r == "CO2RR", "partial_current_density").otherwise(only))
            .when(
                key.isin("eta", "overpotential", "overpotentials", "eta10"),
                F.when(r.isin("HER", "OER", "HZOR"), "overpotential_10mAcm-2").otherwise(only),
            )
            .when(key == "potential", only)
            .when(key.isin("e12", "halfwavepotential", "halfwave"), "half_wave_potential")
            .when(key.isin("j0", "exchangecurrentdensity"), "exchange_current_density")
            .when(key == "massactivity", "mass_activity")
            .when(key.isin("fe", "faradaicefficiency", "faradicefficiency", "faradaiceff"), "faradaic_efficiency")
            .when(key.isin("partialcurrentdensity", "jpartial", "partialj"), "partial_current_density")
            .otherwise(only)
        )

    return let(pick, F.regexp_replace(F.lower(folded), r"[\s_/\-]+", ""))


def validate_samples(samples: DataFrame) -> DataFrame:
    """Adds ``violation``: a missing field or an answer that is no non-empty JSON object; null when fine."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    keys = F.json_object_keys("answer")
    reason = (
        F.when(blank("source"), "missing_source")
        .when(blank("question"), "missing_question")
        .when(blank("answer"), "missing_answer")
        .when(keys.isNull() | (F.size(keys) == 0), "answer_not_a_json_object")
    )
    return samples.withColumn("violation", reason)


def extra_columns(df: DataFrame, allowed=("source", "question", "answer", "topic", "level", "file_name", "meta")) -> list[str]:
    """Columns outside the sample layout."""
    return sorted(set(df.columns) - set(allowed))


def request_candidates(rows: DataFrame, source_file: str | Column, abstract: str = "abstract", doi: str = "doi") -> DataFrame:
    """Rows with cleaned abstract, row key and the reason they give no request (null when they do)."""
    from siftlab.functions.documents import clean_markup

    name = F.lit(source_file) if isinstance(source_file, str) else source_file
    keys = [blank_to_null(F.col(c)) for c in ("openalex_id", "doi", "title") if c in rows.columns]
    key = F.coalesce(*keys, F.concat(name, F.lit("#"), F.col("row_number").cast("string")))
    cleaned = rows.withColumn("abstract", clean_markup(F.col(abstract)))
    reason = F.when(F.col("abstract") == "", "skipped_empty_abstract").when(
        blank_to_null(F.col(doi)).isNull(), "skipped_missing_doi"
    )
    return cleaned.withColumn("row_key", key).withColumn("skip_reason", reason)


def mentions_acid(c) -> Column:
    """Abstract names an acidic medium."""
    return text_or_empty(c).rlike(K.ACIDIC_PATTERN)
